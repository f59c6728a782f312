"""The pipeline's stages, each held against a naive version on a small fixture."""

import random
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from demandlens.llm import langid, mixing, quality
from demandlens.llm.queries import tokenizer_path
from tests.llm.test_methods import jaccard_components, naive_phrases, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, kept boolean, hw string"
LABELS = "doc_id long, quality int, toxic int"
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows_of(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def alike(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, near copies, repeated rows and ids, clashing columns."""
    rng = random.Random(21)
    good = ["".join(rng.choices("abcdef", k=4)) for _ in range(120)]
    text = lambda n: " ".join(rng.choices(good, k=n))
    base = [text(n) for n in (60, 80, 100, 130, 3000)]
    near = [" ".join([*b.split()[:-1], "tail"]) for b in base]
    junk = [" ".join(w + "###" for w in rng.choices(good, k=80)) for _ in range(6)]
    texts = [*base, *near, *junk, base[0], "same same same " * 40, "12 34 " * 60, None, "", "short", *(text(70) for _ in range(20))]
    rows = [(k, t, ["en", None, "de"][k % 3], [None, "a", "b"][k % 3], None, 5, False, "x") for k, t in enumerate(texts)]
    rows += [rows[2], (4, text(90), "en", "a", 1, 1, True, None), (None, base[3], None, None, None, None, None, None), (None, text(60), "en", "b", 2, 2, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 0) for k in (*range(5), *range(25, 45))] + [(k, 0, 0) for k in range(10, 16)] + [(None, 1, None), (3, None, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_quality_stage(spark, docs, sf_dir, empty):
    """The base rules alone where nothing is labelled; with labels, the operator's verdicts, which are tested for themselves."""

    def passes(t):
        w = words_of(t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w) >= 50 and 2 * len(marked) <= len(w)

    every = rows_of(docs)
    alike(rows_of(corpus_pipeline.quality_rules(spark, docs, empty)), [r for r in every if passes(r[1])])
    judged = quality.quality_rules(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    verdict = {(r["doc_id"], r["text"]): r["kept"] for r in judged}
    kept = rows_of(corpus_pipeline.quality_rules(spark, docs, sf_dir))
    alike(kept, [r for r in every if verdict[r[0], r[1]]])
    assert not any("###" in r[1] for r in kept) and {r[0] for r in kept} >= {*range(4), *range(25, 40)}


def test_language_stage(spark, docs):
    samples = langid.learn(docs.filter(~langid.held_out(docs["doc_id"])))
    names = [lang for lang, _ in samples]
    want = []
    for i, t, _, *rest in rows_of(docs):
        if t and re.search(r"[^\W\d_]", t):
            cost = [naive_phrases(t.lower().encode(), s) * c for (_, s), c in zip(samples, langid.Model(samples).cost, strict=True)]
            want.append((i, t, names[cost.index(min(cost))], *rest))
    alike(rows_of(corpus_pipeline.language_id(spark, docs, "")), want)


def test_near_duplicate_stage(spark, docs):
    every = rows_of(docs)
    part = jaccard_components({k: shingles(r[1], 5) for k, r in enumerate(every)})
    first = {}
    for k, r in enumerate(every):
        order = (r[0] is None, r[0] or 0)
        first[part[k]] = min(order, first.get(part[k], order))
    got = rows_of(corpus_pipeline.near_duplicates(spark, docs, ""))
    alike([(r[0] is None, r[0] or 0) for r in got], list(first.values()))
    assert not Counter(got) - Counter(every)
    kinds = Counter(part[every.index(r)] for r in got)
    assert set(kinds.values()) == {1} and set(kinds) == set(part.values())


def test_mixing_stage(spark, docs):
    got = rows_of(corpus_pipeline.mix_sources(spark, docs, ""))
    known = {}
    for i, t, lang, source, _ in rows_of(docs):
        known.setdefault((i, lang, source), []).append(words_of(t))
    total = Counter()
    for i, t, lang, source, n in got:
        assert n == len(t)
        runs = [words_of(x) for x in t.split("\n")]
        assert any(runs_in(runs, w) for w in known[i, lang, source])
        total[source] += len(words_of(t))
    goal = mixing.targets({s: sum(len(w) for (_, _, x), ws in known.items() if x == s for w in ws) for s in {k[2] for k in known}})
    for s, target in goal.items():
        assert abs(total[s] - target) <= 128
    taken = Counter()
    for r in mixing.mix(docs).taken().collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = Counter()
    for i, t, *_ in got:
        mixed[i] += len(words_of(t))
    assert {k: n for k, n in taken.items() if n} == dict(mixed)


def runs_in(runs, words):
    """Whether the runs follow each other in words."""
    at = 0
    for run in runs:
        while words[at : at + len(run)] != run:
            at += 1
            if at > len(words):
                return False
        at += len(run)
    return True


def test_packing_stage(spark, docs):
    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    whole = {}
    for i, text, *_ in rows_of(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[i, len(ids)] += len(ids)
        whole.setdefault((i, len(ids)), []).append(ids)
    got, places = Counter(), {}
    for r in corpus_pipeline.pack_sequences(spark, docs, "").collect():
        key = r["doc_id"], r["doc_tokens"]
        got[key] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        cut = [ids[r["start"] : r["start"] + r["length"]] for ids in whole[key]]
        assert r["ids_crc32"] in [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c)) for c in cut]
    assert got == want
    for p in places.values():
        ends = 0
        for offset, length in sorted(p):
            assert offset == ends
            ends += length
        assert ends == 1024 or ends & (ends - 1) == 0


def test_run_and_empty_tables(spark, sf_dir, empty):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len(rows) == len(again)
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in again)
    assert not {r["doc_id"] for r in rows} & {*range(10, 16), 16, 17, 18, 19, 20}  # junk, copies, repeats, numbers, nothing
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0
