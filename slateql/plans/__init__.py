"""From SQL text to statements: tokens, syntax tree, parser."""
