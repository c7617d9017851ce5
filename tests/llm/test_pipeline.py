"""The pipeline against a plain computation of every stage."""

import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from docloom.llm import bpe, language

FOLDER = "/root/testdata/sf0.001"


def without_repeats(texts):
    seen, data, out = Counter(), [t.encode() for t in texts], []
    for b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def linked_firsts(rows):
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return [r for i, r in enumerate(rows) if top(i) == i]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cleaned(text, windows):
    found = list(WORD.finditer(text))
    lower = [m[0].translate({c: c + 32 for c in range(65, 91)}) for m in found]
    hit = {i + j for n in {len(w) for w in windows} for i in range(len(lower) - n + 1) if tuple(lower[i : i + n]) in windows for j in range(n)}
    if not hit:
        return text
    gaps = [text[a:b] for a, b in zip([0, *[m.end() for m in found]], [*[m.start() for m in found], len(text)], strict=True)]
    return gaps[0] + "".join(("" if i in hit else m[0]) + ("" if i in hit and i + 1 in hit else gaps[i + 1]) for i, m in enumerate(found))


def test_run(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learn(language.learned_part(documents))
    rows = [r for r, p in zip(rows, language.predict(model, [t for _, t in rows])[0], strict=True) if p != "und"]
    rows = linked_firsts(rows)
    texts = without_repeats([t for _, t in rows])
    items = [WORD.findall(r["text"].translate({c: c + 32 for c in range(65, 91)})) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    want = {d: encoding.encode_ordinary(cleaned(t, windows)) for (d, _), t in zip(rows, texts, strict=True)}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want
    assert len(want) < documents.count()


def test_stages_keep_the_columns(spark):
    layout = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "the cat of the house", "en", "s", 20), (4, "the cat of the house", "en", "s", 20), (None, "a dog and the cat", "en", "s", 17), (7, "the dog " * 30_000, "en", "s", 240_000)]
    for docs in (spark.createDataFrame(rows, layout), spark.createDataFrame([], layout)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
        assert len(got) in (0, 3)


def test_stages_keep_columns_of_any_name(spark):
    names = ["found", "row", "key", "one", "own", "turn", "__hit", "__row", "spans", "bits", "keys", "class_id"]
    rows = [(1, "the cat of the house and the garden", "en"), (2, "the dog and the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "length(text) AS n_chars", *[f"'{n}' AS `{n}`" for n in names])
    docs = docs.withColumn("n_chars", docs["n_chars"].cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "n_chars", *names]
        assert all(r[n] == n for r in docs.collect() for n in names)
