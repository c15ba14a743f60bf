import json

from pyspark.sql import functions as F

from terseframe.functions import code, shell
from terseframe.functions.text import content_hash
from terseframe.operators import budget, callgraph, reports, store
from terseframe.operators import messages as m
from terseframe.plans import pipeline, requests
from terseframe.sources import jsonl
from terseframe.sources.storage import Storage, write_report

LONG = "The quick brown fox jumps over the lazy dog and then writes a long report about every single step it took. "


def chat(spark, turns, role=None):
    rows = [(1, 1, i, (role or {}).get(i, "user" if i % 2 == 0 else "assistant"), t) for i, t in enumerate(turns)]
    return spark.createDataFrame(rows, "request_id long, request_seq long, msg_idx long, role string, content string")


def test_near_copies(spark):
    rows = {r["msg_idx"]: r for r in m.near_dup_turns(chat(spark, [LONG, "hi", LONG, "hi", LONG.replace("lazy", "lame"), "other words " * 20])).collect()}
    assert rows[2]["ref_idx"] == 0 and rows[2]["same_bits"] == 64 and rows[2]["new_content"] == "[DEDUP:ref=0 sim=1.00]"
    assert not rows[3]["is_dup"] and not rows[5]["is_dup"] and rows[4]["ref_idx"] == 2


def test_simhash_is_its_definition(spark):
    import hashlib

    def plain(t):
        s = [0] * 64
        for i in range(len(t) - 3):
            h = int(hashlib.md5(t[i : i + 4].encode()).hexdigest()[16:], 16)
            for b in range(64):
                s[b] += 1 if h >> b & 1 else -1
        v = sum(1 << b for b in range(64) if s[b] > 0)
        return v - (1 << 64) if v >= 1 << 63 else v

    texts = ["", "abc", "abcd", LONG, "aé…🦆bc" * 9]
    got = [r["h"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", m.simhash64("t").alias("h")).orderBy("i").collect()]
    assert got == [plain(t) for t in texts]


def test_decay(spark):
    turns = [f"turn {i} about `mod_{i}.py` and **bold** words" for i in range(15)]
    turns[1] = "[PIN] keep me"
    rows = {r["msg_idx"]: r for r in m.decay(chat(spark, turns, {0: "system"})).collect()}
    assert rows[0]["new_content"] == turns[0] and rows[1]["new_content"] == "keep me" and rows[14]["new_content"] == turns[14]
    assert rows[2]["new_content"].startswith("[U·mod_2.py, ") and rows[8]["new_content"] == turns[8].replace("**", "")
    assert [rows[i]["zone"] for i in (0, 1, 4, 5, 12, 13)] == ["system", "pinned", "digest", "partial", "partial", "recent"]


def test_boundary_and_tools(spark):
    assert m.cache_boundary(chat(spark, ["s"] + ["t"] * 10, {0: "system"})).first()["boundary"] == 8
    tools = spark.sql("select array(named_struct('name','zebra','v',1), named_struct('name','apple','v',2), named_struct('name','apple','v',3)) as t")
    assert [(x["name"], x["v"]) for x in tools.select(m.sort_tools(F.col("t")).alias("t")).first()["t"]] == [("apple", 2), ("apple", 3), ("zebra", 1)]
    hints = m.cache_hints(chat(spark, ["t"] * 5), F.lit("anthropic")).where("cache_hint").collect()
    assert [h["msg_idx"] for h in hints] == [1]


def test_offload_round_trip(spark):
    rows = spark.createDataFrame([(1, LONG * 5, "code"), (2, "small", "x"), (3, LONG * 5, "")], "seq long, content string, label string")
    out = store.offload(rows, 10).orderBy("seq").collect()
    assert out[0]["new_content"].startswith("[CCR:") and out[1]["new_content"] == "small" and " | chunk | " in out[2]["new_content"]
    entries = store.store_entries(rows, 10)
    assert entries.count() == 1
    asked = spark.createDataFrame([(out[0]["new_content"],), ("[CCR:0123456789abcdef | x | ~1 tok]",)], "pointer string")
    got = [r["resolved"] for r in store.resolve(asked, entries).collect()]
    assert LONG * 5 in got and "[CCR ERROR] No entry found for hash '0123456789abcdef'." in got


def test_versions_and_deltas(spark):
    v1 = "".join(f"def f{i}():\n    return {i}\n" for i in range(40))
    v2 = v1.replace("return 7\n", "return 8\n")
    rows = spark.createDataFrame([("a.py", 1, v1), ("a.py", 2, v1), ("a.py", 3, v2), ("a.py", 4, "all new"), ("b.py", 5, v1)], "path string, seq long, content string")
    got = {r["seq"]: r for r in store.file_deltas(store.file_versions(rows)).collect()}
    assert [got[i]["version"] for i in (1, 2, 3, 4, 5)] == [1, 1, 2, 3, 1]
    assert got[2]["new_content"] == "[FILEREF:a.py@v1 unchanged]" and got[3]["new_content"].startswith("[FILEDIFF:a.py@v1->v2]\n--- a.py@v1")
    assert not got[4]["is_delta"] and got[4]["new_content"] == "all new" and not got[1]["is_delta"]


def test_cross_component(spark):
    rows = spark.createDataFrame([(1, "a", "r", LONG * 3), (2, "b", "r", LONG * 3), (3, "a", "r", LONG * 3), (4, "b", "s", LONG * 3), (5, "", "r", LONG * 3), (6, "b", "r", "short")], "seq long, component_id string, run_id string, content string")
    got = {r["seq"]: r for r in store.cross_component(rows).collect()}
    assert [got[i]["is_cross"] for i in range(1, 7)] == [False, True, False, False, False, False]
    assert " | xcomp:a | " in got[2]["new_content"]


def test_meta_and_routes(spark):
    df = spark.sql("select map('X-Meta-Component', 'c1', 'x-meta-run', '') as h, named_struct('component_id', 'c2', 'run_id', 'r2', 'budget_tokens', 'many') as b, '/openai/v1' as p, 'O1-mini' as mo")
    r = df.select(store.request_meta(F.col("h"), F.col("b"), "x-meta-").alias("m"), store.route(F.col("p")).alias("r"), store.provider(F.col("mo")).alias("pr")).first()
    assert r["m"].asDict() == {"component_id": "c1", "run_id": "r2", "budget_tokens": None} and r["r"]["upstream"] == "openai" and r["r"]["tail"] == "/v1" and r["pr"] == "openai"


def test_budget(spark):
    rows = spark.createDataFrame([(10000, None), (1000, 5000), (100000, 1000), (10000, 6000)], "raw_tokens long, budget_tokens long")
    got = {(r["raw_tokens"], r["budget_tokens"]): r for r in budget.plan(rows).collect()}
    assert [got[k]["tier"] for k in ((10000, None), (1000, 5000), (100000, 1000), (10000, 6000))] == [5, 1, 5, 3]
    assert all(r["offload_tokens"] <= 2000 for r in got.values())


def test_call_graph(spark):
    files = spark.createDataFrame([("m.py", "def a():\n    b()\n\ndef b():\n    a()\n\ndef c():\n    return 1\n")], "path string, code string")
    symbols, calls = callgraph.index_files(files)
    reached = callgraph.reachable(calls, spark.createDataFrame([("a",)], "symbol string"))
    assert {r["symbol"] for r in reached.collect()} == {"a", "b"}
    assert "return 1" not in callgraph.prune_files(files, symbols, reached).first()["pruned"]


def test_reports(spark):
    empty = spark.createDataFrame([], "id long, raw_tokens long, compressed_tokens long, latency_ms double, upstream_ms double, cache_hit boolean, offloaded boolean, component_id string, breakdown string, ts double")
    assert reports.summary(empty).first()["saved_bp"] == 0
    rows = spark.createDataFrame([(1, 1000, 400, 2.0, 7.0, True, False, "a", '{"x": 5}', 1.0), (2, 1000, 900, 4.0, 8.0, False, True, "", "bad", 2.0)], empty.schema)
    s = reports.summary(rows).first()
    assert (s["saved_tokens"], s["saved_bp"], s["avg_latency_ms"], s["offloads"]) == (700, 3500, 3.0, 1)
    assert [tuple(r) for r in reports.by_algorithm(rows).collect()] == [("x", 5)] and reports.by_component(rows).count() == 1


def test_pipeline(spark):
    turns = ["Certainly! mail me at a@b.org in order to talk.", "```python\n# m.py\ndef f(x):\n    y = x + 1\n    return y\n```", LONG * 80, "ok"]
    got = {r["msg_idx"]: r for r in pipeline.reduce_messages(chat(spark, turns)).collect()}
    assert got[0]["content"] == "mail me at [REDACTED:EMAIL] to talk." and got[0]["hits"] == {"email": 1}
    assert "return y" not in got[1]["content"] and got[1]["s_code"] > 0
    assert got[2]["offloaded"] and got[2]["content"].startswith("[CCR:" + content_hash_of(spark, got[2]["stored"]))
    assert got[3]["content"] == "ok"


def content_hash_of(spark, text):
    return spark.createDataFrame([(text,)], "x string").select(content_hash(F.col("x")).alias("h")).first()["h"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"model": "m", "messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "x", "content": "b"}]}]}\n\nnot json\n{"path": "/p", "ts": 1, "payload": {"messages": []}}\n')
    rows = jsonl.read_requests(spark, str(tmp_path / "a.jsonl"))
    assert rows.count() == 2 and jsonl.read_requests(spark, str(tmp_path / "a.jsonl"), 1).count() == 1
    said = jsonl.messages_of(rows.withColumn("request_id", F.col("line"))).orderBy("request_id", "msg_idx").collect()
    assert [s["content"] for s in said] == ["hi", "a\nb"]


def test_streams_equal_batches(spark, sf, tmp_path):
    from terseframe.sources import tables
    from terseframe.streaming.metrics import hourly

    batch = tables.metrics(spark, sf)
    src = str(tmp_path / "in")
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(batch).collect()))


def payload(spark, turns, budget_tokens, tools=("zeta", "alpha"), model="claude-x"):
    defs = [(n, json.dumps({"name": n})) for n in tools]
    return spark.createDataFrame([(1, model, defs, budget_tokens)], "request_id long, model string, tools array<struct<name:string,definition:string>>, budget_tokens long"), chat(spark, turns)


def test_requests_follow_their_budget(spark):
    turns = [LONG * 6, LONG * 6, "In order to proceed, certainly!", "a", "é", " ".join(f"item {i} of that list" for i in range(700))]
    said = [{"role": "user" if i % 2 == 0 else "assistant", "content": x} for i, x in enumerate(turns)]
    raw = len(json.dumps({"model": "claude-x", "messages": said, "tools": [{"name": "zeta"}, {"name": "alpha"}]})) // 4
    got = {}
    for b in (None, raw + 5, int(raw * 0.9), 10):
        _, done = requests.reduce_requests(*payload(spark, turns, b))
        got[b] = done.first()
    assert all(r["raw_tokens"] == raw for r in got.values())
    assert [r["tier"] for r in got.values()] == [-1, 1, 1, 5]
    # tier 1 has near copies alone; without a budget all stages run, and the strongest tier stores the long text
    assert got[raw + 5]["near_dup"] > 0 == got[raw + 5]["prose"] and got[None]["prose"] > 0 and got[10]["offload"] > 0
    assert [x["name"] for x in got[10]["tools"]] == ["alpha", "zeta", requests.TOOL]
    assert got[None]["hint_idx"] == 2 and got[10]["saved_tokens"] == raw - got[10]["compressed_tokens"] > 0
    messages, done = requests.reduce_requests(*payload(spark, turns, 10))
    rows = sorted(messages.collect(), key=lambda r: r["msg_idx"])
    new = [{"role": r["role"], "content": [{"type": "text", "text": r["content"], "cache_control": {"type": "ephemeral"}}] if r["cache_hint"] else r["content"]} for r in rows]
    defs = [json.loads(x["definition"]) for x in done.first()["tools"]]
    assert done.first()["compressed_tokens"] == len(json.dumps({"model": "claude-x", "messages": new, "tools": defs})) // 4
    asked, none = payload(spark, turns, 10)
    bare = requests.reduce_requests(asked, none.limit(0))[1].first()
    assert bare["n_messages"] == 0 and [x["name"] for x in bare["tools"]] == ["alpha", "zeta"] and bare["hint_idx"] is None


def test_tool_calls_and_headers(spark):
    block = "array<struct<type:string,id:string,name:string,hash:string,tool_use_id:string,content:string>>"
    said = ("text", None, None, None, None, "hi")
    rows = spark.createDataFrame([(1, [("tool_use", "a", "get", "h1", None, None), said, ("tool_use", "b", "get", "h2", None, None)]), (2, [said]), (3, None)], f"response_id long, content {block}")
    entries = spark.createDataFrame([("h1", "whole text")], "hash string, content string")
    got = {r["response_id"]: r["content"] for r in store.answer_tool_calls(rows, entries, "get").collect()}
    assert [(x["tool_use_id"], x["content"]) for x in got[1][3:]] == [("a", "whole text"), ("b", "[CCR ERROR] No entry found for hash 'h2'.")] and len(got[2]) == 1 and got[3] is None
    df = spark.sql("select map('Host', 'h', 'X-Meta-Run', 'r', 'accept', 'a') as h, map('Content-Encoding', 'gzip', 'x-cache', 'HIT') as b")
    r = df.select(store.forward_headers(F.col("h"), "X-Meta-").alias("f"), store.return_headers(F.col("b"), "x-meta-", F.lit(12), F.lit(3.5), F.lit("c"), F.lit(-1)).alias("r"), store.cache_hit(F.col("b")).alias("c")).first()
    assert r["f"] == {"accept": "a", "content-type": "application/json"} and r["c"]
    assert r["r"] == {"x-cache": "HIT", "x-meta-tokens-saved": "12", "x-meta-compression-pct": "3.5", "x-meta-component": "c"}


def test_storage(spark, tmp_path):
    s = Storage(spark, f"file://{tmp_path}/store")
    assert s.entries().count() == 0 and s.latest_versions().count() == 0
    for seq, label in ((1, "a"), (2, "b")):
        s.append("entries", spark.createDataFrame([("h", "text", label, 4, seq)], "hash string, content string, label string, size_bytes long, seq long"))
    s.append("metrics", spark.createDataFrame([("r", 10, 4)], "request_id string, raw_tokens long, compressed_tokens long"))
    s.append("mask_log", spark.createDataFrame([("email", 2), ("email", 3), ("ssn", 9)], "pattern string, count long"))
    assert [(r["hash"], r["label"]) for r in s.entries().collect()] == [("h", "b")]
    assert [tuple(r) for r in reports.mask_totals(s.read("mask_log")).collect()] == [("ssn", 9), ("email", 5)]
    assert reports.status(s.read("metrics"), s.entries()).first().asDict() == {"requests": 1, "raw_tokens": 10, "saved_tokens": 6, "saved_bp": 6000, "entries": 1}
    for seq, code in ((1, "def a():\n    b()\n"), (2, "def c():\n    d()\n")):
        files = spark.createDataFrame([("m.py", code)], "path string, code string")
        assert s.index_files(["m.py"], *callgraph.index_files(files), seq) == 1
    assert [r["symbol"] for r in s.symbols().collect()] == ["c"] and [r["callee_symbol"] for r in s.calls().collect()] == ["d"]
    write_report(reports.status(s.read("metrics"), s.entries()), f"file://{tmp_path}/report", algorithms=spark.createDataFrame([("x", 5)], "algorithm string, saved long"))
    assert json.loads("\n".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/report").collect()))["algorithms"] == [{"algorithm": "x", "saved": 5}]
    s.flush()
    assert s.entries().count() == 0 and s.read("metrics").count() == 0 and s.read("mask_log").count() == 3


def test_recorded_requests_come_back(spark, tmp_path):
    body = json.dumps({"model": "m", "messages": [{"role": "user", "content": 'say "hi"\n'}]}, indent=1)
    rows = spark.createDataFrame([('/v1 "x"', 1.5, body), ("/v1", 2.0, "no json")], "path string, ts double, payload string")
    jsonl.record_requests(rows, str(tmp_path / "log"))
    line = json.loads(spark.read.text(str(tmp_path / "log")).first()["value"])
    assert line == {"path": '/v1 "x"', "ts": 1.5, "payload": json.loads(body)}
    got = jsonl.read_requests(spark, str(tmp_path / "log")).first()
    assert got["model"] == "m" and got["messages"][0]["content"] == 'say "hi"\n'


def test_long_dotted_lines(spark):
    """A line of 100,000 dotted parts is read without a stack frame for each."""
    rows = [("a." * 100_000 + "SomeError: x\nend",), ("x..Error\n.Error\nok.ValueError: y",), ("no such line",), ("a.Error..b",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").select(shell.root_exception(F.col("t")).alias("x")).collect()]
    assert got[0].endswith("SomeError: x") and got[1:] == ["ok.ValueError: y", None, "a.Error..b"]


def test_skeletons_of_nested_functions():
    source = 'import os\n\nclass A:\n    """doc"""\n    def f(self, x) -> int:\n        # note\n        def g():\n            return 1\n\n        return g()\n    y = 1\n\nasync def h():\n\n    pass\nz = 2\ndef last(): return 3'
    assert code.skeleton(source) == "import os\n\nclass A:\n    \n    def f(self, x) -> int:\n        ...\n    y = 1\n\nasync def h():\n    ...\nz = 2\ndef last():\n    ...\n"


def test_block_lists_are_read_by_each_stage_its_own_way(spark):
    blocks = [{"type": "text", "text": "first"}, {"type": "tool_result", "content": "result", "id": 7}, {"type": "note", "text": "aside"}, "loose", {"type": "text", "text": "second"}]
    rows = spark.createDataFrame([(1, json.dumps(blocks)), (2, "plain [1]"), (3, None), (4, "[1, 2"), (5, json.dumps([{"type": "image"}]))], "i int, raw string")
    got = {r["i"]: r for r in rows.select("i", jsonl.block_texts(F.col("raw")).alias("t"), jsonl.write_back("raw", F.lit("new")).alias("w")).collect()}
    assert got[1]["t"].asDict() == {"engines": "first\nresult\naside\nsecond", "classify": "first  aside second", "near_dup": "first\nsecond", "keywords": "first result aside second", "plain": "first  aside second"}
    assert set(got[2]["t"]) == {"plain [1]"} and set(got[3]["t"]) == {""} and set(got[4]["t"]) == {"[1, 2"}
    assert json.loads(got[1]["w"]) == [{"type": "text", "text": "new"}, *blocks[1:]] and got[2]["w"] == "new" and got[4]["w"] == "new"
    assert json.loads(got[5]["w"]) == [{"type": "image"}]


def test_project_walk(spark, tmp_path):
    for name in ("a.py", "sub/b.pyi", "c.txt", ".git/d.py", "sub/node_modules/e.py", "dist/f.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    got = {r["path"].split(str(tmp_path))[1]: r["code"] for r in jsonl.read_code(spark, str(tmp_path)).collect()}
    assert got == {"/a.py": "# a.py\n", "/sub/b.pyi": "# sub/b.pyi\n"}
