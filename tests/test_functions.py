import json

from pyspark.sql import functions as F

from terseframe.functions import classify, code, jsoncrush, masks, prose, shell
from terseframe.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_lengths_and_tokens(spark):
    for s in ("", "abc", 'q"\\\n\t', "é…🦆\x01", "x" * 100):
        r = spark.createDataFrame([(s,)], "x string").select(tx.json_string_length(F.col("x")).alias("j"), tx.tokens(F.col("x")).alias("t")).first()
        assert r["j"] == len(json.dumps(s)) and r["t"] == max(1, int(len(s) / 3.5))


def test_lines_keep_their_ends(spark):
    s = "a\nb\r\nc\rd\x0be\u2028f"
    assert one(spark, s, tx.lines_with_ends) == s.splitlines(keepends=True)
    assert one(spark, "", tx.lines_with_ends) == []


def test_kinds(spark):
    cases = {
        "hello there": "conversation",
        '{"a": 1}': "json_data",
        "```python\nx\n```": "code",
        "def f\nclass A": "code",
        "Traceback (most recent call last)": "shell_output",
        "see\n```py\nx\n```\nFAILED": "mixed",
        "{" + "x" * 120: "json_data",
    }
    for text, want in cases.items():
        assert one(spark, text, classify.kind) == want == classify.kind_of(text)


def test_blocks():
    text = "Some words.\n```json\n{}\n```\n  \n```\n$ ls\n```\nend"
    assert [(k, g) for k, _, g in classify.blocks_of(text)] == [("conversation", None), ("json_data", "json"), ("shell_output", None), ("conversation", None)]
    assert classify.blocks_of("plain")[0][0] == "conversation"


def test_prose(spark):
    assert one(spark, "Certainly! We do this in order to make use of it.  \nI hope this helps!", lambda c: prose.minify(c)) == "We do this to use it."
    assert one(spark, "## T\n**b** *i* ~~s~~", prose.strip_markdown) == "T\nb i s"
    assert one(spark, "a\n\n\n\nb", lambda c: prose.minify(c)) == "ab"


def test_masks(spark):
    text = "mail a@b.org key sk-" + "a1" * 20 + " card 4111 1111 1111 1111 bad 4111111111111112 password=hunter22"
    got, hits = masks.mask(text)
    assert got == "mail [REDACTED:EMAIL] key [REDACTED:API_KEY] card [REDACTED:CC]bad 4111111111111112 [REDACTED:PASSWORD]"
    assert hits == {"email": 1, "sk_key": 1, "credit_card": 1, "password_kv": 1}
    assert masks.mask(got)[0] == got and masks.mask("clean text") == ("clean text", {})
    assert one(spark, "4111111111111111", masks.luhn_ok) is True and masks.luhn("4111111111111111")
    assert abs(one(spark, "aabb", masks.entropy_bits) - 1.0) < 1e-12


def test_shell(spark):
    log = 'tests/a.py::x PASSED\n--- PASS: y\nerror one 1\nerror one 2\nerror one 3\n  File "/l/site-packages/a.py"\n  File "/l/site-packages/b.py"\nboom\nValueError: bad\n'
    got = one(spark, log, lambda c: shell.minify_shell(c))
    assert "PASSED" not in got and "ValueError: bad" in got and "error one 1 [×3]" in got
    assert one(spark, "", lambda c: shell.minify_shell(c)) == ""
    long = "".join(f"line {i * 7919 % 1000} {'abc'[i % 3] * 9}\n" for i in range(300)) + "KeyError: k\n"
    lines = one(spark, long, lambda c: shell.cap_lines(tx.lines_with_ends(c), 200))
    assert len(lines) == 201 and lines[100] == "\n… [101 lines omitted] …\n"


def test_json():
    deep = json.dumps({"a": {"b": {"c": {"d": {"e": 1}}}}})
    assert "…" in json.loads('"' + jsoncrush.crush(deep, 2).replace('"', "'").replace("\\u2026", "…") + '"')
    assert json.loads(jsoncrush.crush(json.dumps(list(range(100))))) == [0, 1, 2, 3, 4, "… (94 more)", 99]
    rows = [{"k": i, "u": "USD"} for i in range(3)]
    assert jsoncrush.hoist(rows) == {"__constant_fields": {"u": "USD"}, "__items": [{"k": 0}, {"k": 1}, {"k": 2}]}
    assert json.loads(jsoncrush.crush(json.dumps(rows))) == {"__constant_fields": {"k": "…", "u": "…"}, "__items": [{}, {}, {}]}
    assert jsoncrush.crush("not json") == "not json"
    assert jsoncrush.crush_embedded("x " + json.dumps({"a": list(range(60))}) + " y")[1] > 0
    assert jsoncrush.knee([1.0, 0.5, 0.2]) == 2 and jsoncrush.knee([1.0, 0.1]) == 2


def test_code(spark):
    src = 'class A:\n    """doc"""\n    def f(self, x) -> int:\n        y = x  # c\n        return y\n\nz = 1\n'
    got = code.compact(src, "a.py")
    assert "return" not in got and "def f(self, x) -> int:" in got and "doc" not in got and "z = 1" in got
    assert code.compact("fn x() {}", "a.rs") == "fn x() {}" and code.compact("", None) == ""
    assert one(spark, "// src/a.py\nx", code.file_hint) == "src/a.py" and one(spark, "none", code.file_hint) is None
    assert one(spark, "d/x.TSX", code.language) == "tsx"
    symbols, edges = code.calls("def a():\n    b()\nclass C:\n    async def d(self):\n        self.e()\n")
    assert symbols == [("a", "function"), ("C", "class"), ("d", "function")] and edges == [("a", "b"), ("d", "e")]
    assert code.calls("def (") == ([], [])
    assert code.prune("def a():\n    return 1\n\ndef b():\n    x = 1\n    return x\n", {"a"}) == "def a():\n    return 1\n\ndef b():\n    ...\n"
