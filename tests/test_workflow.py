"""Requests, caches and whole runs with stand-ins for what is outside."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from docloom.operators import bilingual, chat, editions, requests, rules, segment, workflow
from docloom.operators.batches import cut
from docloom.sources import artifacts

LONG = "words that are long enough to be taken as text that changes"


def sent(*pieces):
    yield b": comment\n"
    for p in pieces:
        yield b"data: " + json.dumps({"choices": [{"delta": {"content": p}}]}).encode() + b"\r\n"
    yield b'data: {"choices": []}\n'
    yield b"data: {broken\n"
    yield "data: [DONE]"


def test_client():
    seen, shown = [], []

    def opener(url, head, data):
        seen.append((url, head, json.loads(data)))
        return sent("He", "y")

    client = requests.Client("http://x/chat/completions", "m", "k", 0.5, opener=opener, observe=shown.append)
    assert client("hello", "be brief", ["q", "a"]) == "Hey" and shown == ["He", "Hey"]
    url, head, data = seen[0]
    assert head["Authorization"] == "Bearer k" and data["stream"] and data["temperature"] == 0.5 and data["top_p"] == 1.0
    assert [m["role"] for m in data["messages"]] == ["system", "user", "assistant", "user"]
    with pytest.raises(ValueError):
        requests.Client("u", "m", "", opener=opener)("x", "")


def test_patience():
    waits = []

    def failing(times):
        left = [times]

        def inner(prompt, system, history=None):
            left[0] -= 1
            if left[0] >= 0:
                raise OSError("down")
            return prompt

        return requests.Patient(inner, 100, pause=waits.append)

    assert failing(2)("p", "") == "p" and len(waits) == 2 and all(5 <= w <= 20 for w in waits)
    answer = failing(9)("p", "")
    assert answer.count("[Local Message] Traceback") == 3 and waits[-1] == 5

    def short(prompt, system, history=None):
        if len(prompt) > 1000:
            raise requests.TooLong("too long")
        return prompt

    patient = requests.Patient(short, 3000)
    assert len(patient("x" * 5000, "")) <= 1000 and patient.states[-1] == "done" and "clipped" in patient.states
    assert requests.Patient(lambda p, s: (_ for _ in ()).throw(requests.TooLong("never")), 600)("x" * 9, "").endswith("never")


def test_clip_facts(spark):
    df = spark.createDataFrame([(1, "t" * 10, ["h" * 300]), (2, "t" * 300, ["h"])], "id int, text string, history array<string>")
    out = chat.clipped(df, 100).withColumnRenamed("text", "clipped").select("id", "clipped").join(df, "id")
    got = {r["id"]: r["f"] for r in out.select("id", chat.clip_facts(F.col("text"), F.col("history"), F.col("clipped"), 100).alias("f")).collect()}
    assert (got[1].mode, got[1].original_full_token_num, got[1].clipped_input_len) == ("only-history", 310, 10)
    assert got[2].mode == "input-and-history" and got[2].original_input_len == 300 and got[2].clipped_input_len <= 100


def files(spark):
    main = "\\documentclass{article}\n\\begin{document}\n\\maketitle\n\\input{body}\n\\end{document} \\ref{a}"
    body = f"\\section{{One}}\n{LONG} one.\n\n{LONG} two.\n\\begin{{figure}}\\caption{{{LONG}}}\\end{{figure}}\n% note\n"
    rows = [("p", 0, "main.tex", main), ("p", 1, "body.tex", body), ("q", 0, "main.tex", main.replace("body", "nothing"))]
    return spark.createDataFrame(rows, "project string, ord int, path string, content string")


@pytest.fixture
def answer():
    return lambda prompt, system: prompt.rsplit("：\n\n", 1)[1].replace("words", "WORDS")


def test_run(spark, tmp_path, answer):
    kept = lambda df, name: artifacts.saved(df, f"file://{tmp_path}", name)
    got = {r["doc_id"]: r for r in workflow.run(files(spark), answer, kept, message="a note").collect()}
    p = got["p"]
    assert "\\usepackage{ctex}" in p["source"] and "\\begin{abstract}" in p["source"] and "% note" not in p["source"]
    assert p["result"].count("WORDS") == 3 and "a note" in p["result"] and "words" not in p["result"].split("\\section", 1)[1]
    assert p["error"] is None and p["both"].count("\\begingroup\\color") == 3 and "[翻译] WORDS" in p["both"] and "\\definecolor" in p["both"]
    assert "missing!" in got["q"]["source"] and got["q"]["both"] is not None
    assert artifacts.loaded(spark, f"file://{tmp_path}", "merged").count() == 2
    assert artifacts.loaded(spark, f"file://{tmp_path}", "other") is None
    plain = {r["doc_id"]: r for r in workflow.run(files(spark), lambda p, s: p.rsplit("\n\n", 1)[1], kept, mode="proofread_en").collect()}
    assert "ctex" not in plain["p"]["source"] and plain["p"]["both"] is None


def test_own_prompts(spark, answer):
    docs = spark.createDataFrame([("p", f"\\maketitle {LONG}")], "doc_id string, tex string")
    prompter = lambda parts, mode: parts.withColumn("prompt", F.concat(F.lit(f"{mode}："), F.lit("\n\n"), "content")).withColumn("sys_prompt", F.lit(""))
    parts = workflow.changed(docs, answer, "any", prompter=prompter)
    assert workflow.assembled(parts, "any").first()["tex"] == f"\\maketitle {LONG.replace('words', 'WORDS')}"


def test_editions_that_do_not_fit(spark):
    body = f"\\section{{A}}\n{LONG}\n"
    rows = [(1, body, body + "\\begin{equation}x\\end{equation}\nmore"), (2, body, body), (3, "no body", "none here"), (4, None, body)]
    got = {r["doc_id"]: r for r in editions.edition(spark.createDataFrame(rows, "doc_id int, en string, zh string")).collect()}
    assert got[1]["tex"] is None and "differ" in got[1]["error"] and got[4]["error"]
    assert got[2]["error"] is None and got[2]["tex"].count(LONG) == 2
    assert "none here" in got[3]["tex"]
    one = segment.segment(spark.createDataFrame([(1, body)], "doc_id int, tex string"), "bilingual")
    assert bilingual.paired(one, one.limit(0)).first()["error"] and bilingual.paired(one, one).first()["error"] is None


def test_caption_lists_of_different_lengths():
    two = "\\caption{a} x \\caption{b}"
    assert editions.with_captions("\\caption{A}", two, two) == "\\caption{A \\quad \\quad {\\color{bilingualzhcolor}[翻译] a}} x \\caption{b}"
    assert editions.with_captions("", two, two) == two
    assert editions.with_captions("\\caption{ }", "\\caption{z}", "\\caption{z}") == "\\caption{{\\color{bilingualzhcolor}z}}"


def test_own_rules(spark):
    docs = spark.createDataFrame([(1, f"{LONG} <<hidden>> {LONG}")], "doc_id int, tex string")
    got = segment.segment(docs, table=[*rules.MAIN, ("hide", [r"<<.*?>>"], 0)]).orderBy("seq").collect()
    assert [r["string"] for r in got] == ["", LONG, " <<hidden>> ", LONG]


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.record_batch({"a": ["x" * 10, None, "y" * 100, "", "z"], "b": ["1", "2", None, "4", "5"]})
    parts = list(cut(iter([batch]), ("a", "b"), 20))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_run_log(tmp_path):
    with pytest.raises(KeyError), artifacts.run_log(str(tmp_path / "log"), "own") as log:
        log.warning("seen")
        raise KeyError
    logging.getLogger("own").warning("not seen")
    assert "seen" in (tmp_path / "log").read_text() and "not seen" not in (tmp_path / "log").read_text()


def test_tokens_of_an_encoding(spark, tmp_path):
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for t, i in ranks.items()))
    count = chat.token_counter(str(tmp_path / "ranks"), r"\S+|\s+")
    df = spark.createDataFrame([("p", 0, "abab"), ("p", 1, "xyz"), ("p", 2, "")], "doc_id string, seg_idx long, string string")
    assert [r[0] for r in df.orderBy("seg_idx").select(count(F.col("string"))).collect()] == [2, 3, 0]
    got = chat.chunks(df.where("seg_idx < 2"), limit=3, tokens=count).orderBy("seg_idx", "chunk_idx").collect()
    assert [r["content"] for r in got] == ["abab", "xyz"]
