"""Production parameters that the queries and the pipeline share."""

from __future__ import annotations

import public_tokenizers

#: Vocabulary file; a path is a parameter of the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: From this score on a document counts as toxic.
TOXIC_FROM = 0.7
#: Target weights of the sources; those that are not listed share ``OTHER_WEIGHT``.
SOURCE_WEIGHTS = {f"src{k}": (1, 2, 3, 4)[k % 4] for k in range(20)}
OTHER_WEIGHT = 1
#: Similarity of near duplicates in the pipeline, in hundredths.
NEAR_PERCENT = 80
#: Words whose ids a worker of the pipeline keeps; fewer than alone, as other stages have filled the workers' memory before.
PIPELINE_WORDS = 120_000
PII_KEY = "corpus-2025"
