import pytest

from slateql.errors import ParseError, TokenizeError
from slateql.plans import syntax as S
from slateql.plans.parser import parse_sql
from slateql.plans.tokens import tokenize


def kinds(sql):
    return [(t.kind, t.value) for t in tokenize(sql)]


def test_words_keywords_types_and_operators():
    assert kinds("select Name from T where a_1 And text") == [
        ("keyword", "SELECT"), ("identifier", "Name"), ("keyword", "FROM"), ("identifier", "T"), ("keyword", "WHERE"),
        ("identifier", "a_1"), ("operator", "AND"), ("type", "TEXT"),
    ]
    assert [v for _, v in kinds("= != > >= < <= * , ( )")] == "= != > >= < <= * , ( )".split()


def test_numbers_and_strings():
    assert kinds("12abc") == [("number", "12"), ("identifier", "abc")]
    assert kinds("'it''s'") == [("string", "it"), ("string", "s")]
    assert kinds("'a\nb é\r'") == [("string", "a\nb é\r")]
    assert kinds("<>") == [("operator", "<"), ("operator", ">")]


@pytest.mark.parametrize("sql", ["!", "SELECT @foo", "#comment", "$var", "SELECT name;", "a.b", "-1", "\r", "é"])
def test_bad_characters(sql):
    with pytest.raises(TokenizeError, match="unexpected character"):
        tokenize(sql)


def test_positions_count_bytes():
    with pytest.raises(TokenizeError, match="unexpected character ';' at position 8"):
        tokenize("'éé'  ;".replace("  ", "  "))
    with pytest.raises(TokenizeError, match="unterminated string literal"):
        tokenize("'hello")


def test_every_statement():
    assert parse_sql("SELECT * FROM t") == S.Select("t", None)
    assert parse_sql("SELECT a, b, a FROM t") == S.Select("t", ("a", "b", "a"))
    assert parse_sql("INSERT INTO t VALUES (1, 'x', TRUE)") == S.Insert("t", (S.Literal("number", "1"), S.Literal("string", "x"), S.Literal("identifier", "TRUE")))
    assert parse_sql("UPDATE t SET a = 1 WHERE id = 2") == S.Update("t", "a", S.Literal("number", "1"), S.Comparison("id", "=", S.Literal("number", "2")))
    assert parse_sql("DELETE FROM t") == S.Delete("t")
    assert parse_sql("create table t (id int, s text, b bool)") == S.CreateTable("t", (("id", "INT"), ("s", "TEXT"), ("b", "BOOL")))
    assert parse_sql("DROP TABLE t") == S.DropTable("t")


def test_and_binds_tighter_and_both_are_left_associative():
    def c(x):
        return S.Comparison(x, "=", S.Literal("number", "1"))

    found = parse_sql("SELECT * FROM t WHERE a = 1 AND b = 1 OR c = 1 AND d = 1 OR e = 1").where
    assert found == S.Logical("OR", S.Logical("OR", S.Logical("AND", c("a"), c("b")), S.Logical("AND", c("c"), c("d"))), c("e"))


@pytest.mark.parametrize(
    "sql",
    [
        "", "foo", "FROM t", "SELECT", "SELECT *", "SELECT * FROM", "SELECT *, a FROM t", "SELECT a b FROM t", "SELECT COUNT(*) FROM t", "SELECT text FROM t",
        "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a", "SELECT * FROM t WHERE a =", "SELECT * FROM t WHERE a <> 1", "SELECT * FROM t WHERE 1 = a",
        "SELECT * FROM t WHERE (a = 1)", "SELECT * FROM t WHERE a AND b", "INSERT t VALUES (1)", "INSERT INTO VALUES (1)", "INSERT INTO t (1)",
        "INSERT INTO t VALUES 1", "INSERT INTO t VALUES (1", "INSERT INTO t VALUES ()", "UPDATE SET a = 1", "UPDATE t a = 1", "UPDATE t SET a 1",
        "UPDATE t SET = 1", "DELETE t", "DELETE FROM", "CREATE t (id INT)", "CREATE TABLE t", "CREATE TABLE t ()", "CREATE TABLE t (id)", "CREATE TABLE t (id INT", "DROP t", "DROP TABLE",
    ],
)
def test_parse_errors(sql):
    with pytest.raises(ParseError):
        parse_sql(sql, strict=False)


@pytest.mark.parametrize(
    "sql,clause",
    [
        ("INSERT t", "INSERT: "), ("INSERT INTO t VALUES (", "INSERT VALUES: "), ("INSERT INTO t VALUES (1, )", "INSERT VALUES: "), ("INSERT INTO t VALUES (1", "INSERT: "),
        ("UPDATE SET a = 1", "UPDATE: "), ("UPDATE t SET", "UPDATE SET: "), ("UPDATE t SET a 1", "UPDATE SET: "), ("UPDATE t SET a = ", "UPDATE SET: "), ("UPDATE t SET a = 1 WHERE b", "UPDATE WHERE: "),
        ("DELETE FROM", "DELETE: "), ("DELETE FROM t WHERE a =", "DELETE WHERE: "), ("SELECT a FROM", "SELECT: "), ("SELECT a FROM t WHERE", "SELECT WHERE: "), ("DROP t", "DROP: "),
    ],
)
def test_errors_name_the_clause(sql, clause):
    with pytest.raises(ParseError, match=f"^{clause}"):
        parse_sql(sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM t ORDER", "SELECT a FROM t, u", "INSERT INTO t VALUES (1), (2)", "UPDATE t SET a = 1, b = 2 WHERE id = 1", "DELETE FROM t x WHERE id = 1"])
def test_trailing_tokens(sql):
    with pytest.raises(ParseError, match="after the statement"):
        parse_sql(sql)
    found = parse_sql(sql, strict=False)
    assert getattr(found, "where", None) is None
