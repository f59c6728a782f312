"""Operators held against naive versions of their methods."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlens.llm import chat, html_extract, langid, media, minhash, mixing, packing, sharding, warc
from demandlens.llm.common import scratch
from demandlens.llm.queries import tokenizer_path


def naive_phrases(text: bytes, sample: bytes) -> int:
    """Phrases of a greedy parse into longest substrings of the sample, in blocks."""
    n = 0
    for k in range(0, len(text), langid.BLOCK):
        block, at = text[k : k + langid.BLOCK], 0
        while at < len(block):
            size = 1
            while at + size < len(block) and block[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
    return n


def test_cross_parsing_against_brute_force():
    rng = random.Random(8)
    samples = tuple((lang, "".join(rng.choices(letters, k=700)).encode()) for lang, letters in (("a", "abcd "), ("b", "bcde "), ("c", "éüx ")))
    texts = ["".join(rng.choices("abcdeéüxz ", k=rng.randint(1, 900))).encode() for _ in range(40)] + [b"\xff\0", b"zzz", samples[0][1]]
    model = langid.Model(samples)
    assert model.phrases(texts).tolist() == [[naive_phrases(t, s) for _, s in samples] for t in texts]
    lang, _, bits = model.predict(texts)
    for t, got, low in zip(texts, lang, bits, strict=True):
        cost = {name: naive_phrases(t, s) * math.log2(len(s)) / len(t) for name, s in samples}
        assert got == min(cost, key=cost.get) and abs(low - cost[got]) < 1e-9


def test_languages_of_short_texts_are_learned(spark):
    rows = [(k, "the thing and then " * 20, "en") for k in range(200)] + [(k, "hyvä päivä", "fi") for k in range(200, 230)]
    rows += [(300, "12 34", "xx"), (None, "none", "yy"), (301, None, "zz"), (302, "", "zz"), (303, "text", None), rows[200], (200, "moi moi moi", "fi")]
    samples = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(samples) == {"en", "fi"} and samples["fi"].count(b"\n") == 30
    asked = spark.createDataFrame([(1, "päivä"), (1, "päivä"), (None, "then the")], "doc_id long, text string")
    got = langid.identify(asked.withColumn("lang_pred", F.lit("clash")), tuple(samples.items())).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "en"), (1, "fi"), (1, "fi")]


def test_packing_of_special_strings_and_ranks(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|> x", "a <|endoftext|>", "<|endoftext", "x \n y\t\tz", "one two", "one two", None, " ".join(map(str, range(3000)))]
    df = spark.createDataFrame([(k % 5, x, 1) for k, x in enumerate(texts)], "doc_id long, text string, ids long").repartition(3)
    pieces = packing.pack(df, tokenizer_path())
    rows = pieces.collect()
    got = {}
    for r in rows:
        got.setdefault(r["uid"], []).append(r)
    whole = sorted(b"".join(bytes(p["ids"]) for p in sorted(ps, key=lambda p: p["start"])) for ps in got.values())
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    assert whole == sorted(b"".join(i.to_bytes(4, "little") for i in ids) for ids in want)
    assert [50256, 0] == want[1][-2:]
    digests = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in packing.piece_digests(pieces.drop("uid")).collect())
    assert sorted((d[1], d[2], d[3]) for d in digests) == sorted((r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows)
    # Ranks of rests of one length are 0, 1, 2, ... over all tasks.
    tokens = packing.tokenise(df.unionAll(df).repartition(4), tokenizer_path()).withColumn("r", (F.col("n") % 1024).cast("int"))
    counts = tokens.groupBy("part", "r").agg(F.count("*").alias("n"))
    for parts in (1, packing.PARTS + 1):
        ranks = {}
        for r in packing.ranked(tokens, counts, parts).collect():
            ranks.setdefault(r["r"], []).append(r["rank"])
        assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_permutations_and_draws():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5):
            x = np.arange(n)
            y = mixing.permute(x, np.full(n, n), np.full(n, key))
            assert sorted(y) == list(x)
            assert (mixing.permute(y, np.full(n, n), np.full(n, key), back=True) == x).all()
    quotas = np.array([500, 0, 3000, 77], np.int64)
    one, two = mixing.draw(quotas, 16, 1), mixing.draw(quotas, 16, 2)
    assert (one.sum(0) == quotas).all() and (one.sum(1).max() - one.sum(1).min()) <= 1
    assert (one != two).any() and len({tuple(r) for r in one.tolist()}) > 8
    assert mixing.draw(np.zeros(2, np.int64), 3, 1).tolist() == [[0, 0]] * 3
    assert mixing.draw(np.zeros(0, np.int64), 3, 1).shape == (3, 0)


def test_mix_against_a_table_of_slots(spark):
    """Blocks joined to slots by index, one slot after the other."""
    rng = random.Random(4)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 7, 40, 400]))), rng.choice(["a", "b", None]), 1) for k in range(60)]
    rows += [rows[3], (3, "another text", "a", 2), (None, "no id", "b", 3), (None, "none either", "b", 3), (70, None, None, 4), (71, "", "c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    mix = mixing.mix(df, block=8, shards=5)
    uses = mix.uses.collect()
    size = {}
    for r in uses:
        size[r["source_no"]] = size.get(r["source_no"], 0) + r["size"]
    goal = mixing.targets({s: n for s, n, _ in mix.sources})
    assert [(n, t) for _, n, t in mix.sources] == [(size.get(k, 0), goal[s]) for k, (s, _, _) in enumerate(mix.sources)]
    # The slots, in order of source and shard, each with the block that its permutation names.
    slots, plan = {}, mix.plan
    for s, quota in enumerate(plan.quotas.tolist()):
        for j in range(quota):
            turn, n = divmod(j, int(plan.blocks[s]))
            block = int(mixing.permute(np.array([n]), plan.blocks[[s]], plan.key(np.array([s]), turn))[0])
            shard = next(k for k in range(5) if plan.draws[: k + 1, s].sum() > j)
            place = plan.draws[shard, :s].sum() + j - plan.draws[:shard, s].sum()
            slot = int(mixing.permute(np.array([place]), plan.draws[[shard]].sum(1), np.array([shard + plan.seed]))[0])
            slots[shard, slot] = (s, block)
    assert all(sorted(k for h, k in slots if h == shard) == list(range(plan.draws[shard].sum())) for shard in range(5))
    # Each slot's words: those of its block, of which only a source's last may be short.
    held = {}
    for r in mix.placements().collect():
        held.setdefault((r["shard"], r["slot"]), []).append((r["source_no"], r["length"]))
    assert set(held) == set(slots)
    for at, runs in held.items():
        s, block = slots[at]
        assert {x for x, _ in runs} == {s} and sum(n for _, n in runs) == min(8, size[s] - 8 * block)
    for r in mix.taken().collect():
        assert r["taken"] <= 2 * r["size"]
    for s, (_, n, target) in enumerate(mix.sources):
        assert abs(sum(u["length"] for r in uses if r["source_no"] == s for u in r["uses"]) - target) <= 16
    # Another dealing of the rows, the same mix, but for which of two like rows is which.
    again = mixing.mix(df.repartition(7), block=8, shards=5).taken()
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, mix.taken().collect()), key=repr)


def jaccard_components(sets):
    """Smallest key reachable over pairs of 80 percent, by trying all pairs."""
    root = {k: k for k in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_near_duplicates_of_clashing_ids(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(n)) for n in (30, 60, 90, 3000)]
    swap = lambda t, n: " ".join(w if k % (len(t.split()) // n or 1) else f"x{rng.randint(0, 9)}" for k, w in enumerate(t.split()))
    texts = [*base, *(swap(b, n) for b in base for n in (1, 2, 3, 6)), base[0].upper(), base[1], None, "", "one", "One", "two"]
    ids = [9, 5, 7, 3, *(rng.choice([None, 5, 7, 20, 21, 22]) for _ in range(16)), 40, None, 41, 42, 43, 2, None]
    rows = list(zip(ids, texts, strict=True)) + [(5, base[1]), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, id long, key string, hub long").repartition(3)
    part = jaccard_components({k: shingles(t, 2) for k, (_, t) in enumerate(rows)})
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[part[k]] = min(i, least.get(part[k], i))
    want = []
    for k, (i, t) in enumerate(rows):
        s = shingles(t, 2)
        root = least.get(part[k]) if s else i
        want.append((i, len(s), root, i == root))
    got = [tuple(r) for r in minhash.near_duplicates(df, shingle=2).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, percent=60)


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(3)
    rows = []
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 4000).astype(np.uint64)
        n = round(4000 * share)
        a, b = both[: n + (4000 - n) // 2], np.append(both[:n], both[n + (4000 - n) // 2 :])
        rows.append((share, [minhash.signature(np.sort(x))[1].tolist() for x in (a, b)]))
    df = spark.createDataFrame([(s, *x) for s, x in rows], "s double, x array<long>, y array<long>")
    lanes = range(minhash.LANES)
    for r in df.select("s", minhash.estimate([F.col("x")[k] for k in lanes], [F.col("y")[k] for k in lanes]).alias("e")).collect():
        assert abs(r["s"] - r["e"]) < 0.12
    assert 0.6 < minhash.least_estimate(80) < 0.7


def naive_lzw(codes, bits):
    clear, table, before, out = 1 << bits, {}, None, []
    for c in codes:
        if c == clear:
            table, before = {k: bytes([k]) for k in range(clear)} | {clear: b"", clear + 1: b""}, None
            continue
        entry = table[c] if c in table else before + before[:1]
        out.append(entry)
        if before is not None and len(table) < 4096:
            table[len(table)] = before + entry[:1]
        before = entry
    return b"".join(out)


def test_lzw_against_a_table_of_strings():
    rng = random.Random(12)
    for data in (b"a" * 50_000, bytes(rng.choices(b"ab", k=30_000)), bytes(rng.choices(range(256), k=30_000)), b"\xff", "the thing ä and then the thing ".encode() * 900):
        codes = media._lzw_codes(data).tolist()
        assert codes[0] == 256 and codes[-1] == 257 and naive_lzw(codes[:-1], 8) == data
        stream = media.lzw_encode(data)
        assert media.lzw_decode(stream, 8, len(data)) == data and media.lzw_decode(stream, 8, 7) == data[:7]
        # A stream cut short gives a start of the data; a faulty one does not fail.
        cut = media.lzw_decode(stream[: len(stream) // 2], 8, len(data))
        assert data.startswith(cut) and len(cut) < len(data)
        media.lzw_decode(bytes(rng.choices(range(256), k=500)), 8, 10_000)
    assert media.lzw_decode(b"abc", 0, 9) == media.lzw_decode(b"abc", 200, 9) == b""


def test_media_digests_and_feature(spark):
    import hashlib

    from demandlens.llm.queries import op6_media

    texts = [None, "", "x" * 575, "y" * 576, "é" * 40_000, "x" * 575]
    got = {}

    class Reader:
        def parquet(self, path):
            return spark.createDataFrame([(k, t, b"clash", 3) for k, t in enumerate(texts)], "doc_id long, text string, media binary, n_bytes long")

    rows = op6_media(type("Session", (), {"read": Reader()})(), "nowhere").collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        data = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        stored = media.encode(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        frames = []
        for k in range(0, len(data), 576 * 64):
            shown = np.frombuffer(data[k : k + 576 * 64], np.uint8)
            screen = np.frombuffer(data[: 576 * 64], np.uint8).copy() if not k else screen
            screen[: len(shown)] = shown
            one = ",".join(map(str, np.bincount(screen >> 4, minlength=16)))
            frames.append(f"{100 * (k // (576 * 64))}:{one},{one},{one}")
        assert r["feature"] == ";".join(frames)
        got[r["doc_id"]] = r["feature"], r["media_sha256"]
    assert len(rows) == len(texts) and got[2] == got[5]


def archive(n=5, gz=None, **change):
    rows = [{"record_id": f"<{k}>", "record_type": "resource", "payload": b"p%d" % k * 50} | change for k in range(n)]
    return [gz(warc.record_bytes(r)) if gz else warc.record_bytes(r) for r in rows]


@pytest.mark.parametrize("make", ["plain", "members", "foreign", "whole"])
def test_warc_that_is_cut_or_foreign(make):
    parts = archive(gz={"members": warc.member, "foreign": gzip.compress}.get(make))
    data = gzip.compress(b"".join(archive())) if make == "whole" else b"".join(parts)
    names = lambda d, **how: [h["WARC-Record-ID"] for h, _ in warc.read_records(io.BytesIO(d), **how)]
    assert names(data) == names(data, payloads=False) == [f"<{k}>" for k in range(5)]
    assert [b for _, b in warc.read_records(io.BytesIO(data), lambda h: h["WARC-Record-ID"] == "<3>")] == [b"p3" * 50]
    where = len(data) - 60 if make == "whole" else len(parts[0]) * 2 + len(parts[2]) // 2
    for payloads in (True, False):
        with pytest.raises(ValueError):
            names(data[:where], payloads=payloads)
        assert names(data[:where], payloads=payloads, tolerant=True) == [f"<{k}>" for k in range(len(names(data[:where], tolerant=True)))]
    assert names(b"") == []
    with pytest.raises(ValueError):
        names(b"GIF89a no archive at all" * 300)


def test_warc_headers_of_any_case():
    plain = b"WARC/1.0\r\nwarc-type: resource\r\nwarc-record-id: <a>\r\ncontent-length: 4\r\nX-Own: 1\r\n 2\r\n\r\nWARC\r\n\r\n"
    got = list(warc.read_records(io.BytesIO(plain * 2)))
    assert len(got) == 2 and got[0] == ({"WARC-Type": "resource", "WARC-Record-ID": "<a>", "Content-Length": "4", "X-Own": "1 2"}, b"WARC")


def test_warc_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "INDEX", 2000)
    writer = warc._Writer(scratch(spark, "ranges"), False, 20_000)
    payloads = [bytes(random.Random(k).choices(range(256), k=900)) for k in range(60)]
    batch = pa.RecordBatch.from_pylist([{"record_id": f"<{k}>", "record_type": "resource", "payload": p} for k, p in enumerate(payloads)])
    writer.commit([writer.write(iter([batch])), None])
    reader = warc._Reader(writer.uri, True, 5000, False)
    parts = reader.partitions()
    assert len(parts) > 8 and len({f for p in parts for f, *_ in p.ranges}) > 2
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in rows) == sorted(f"<{k}>" for k in range(60))
    assert {r["record_id"]: r["payload"] for r in rows} == {f"<{k}>": p for k, p in enumerate(payloads)}


def test_chats_are_parsed_from_their_text():
    reading = chat._Reading(1)
    text = "".join(f"{chat.TURN}{r}{chat.BODY}{chat.escape(t)}{chat.STOP}" for r, t in (("user", "a</s>"), ("assistant", "\\<|end|>")))
    for k in range(0, len(text), 7):  # cut anywhere
        reading.add(text[k : k + 7], 0, 0)
    assert reading.row()[:3] == (1, 2, hashlib.sha256(b"user\na</s>\nassistant\n\\<|end|>\n").hexdigest())
    for faulty in ("stray" + text, text + "more", chat.TURN + "user" + chat.STOP):
        reading = chat._Reading(2)
        with pytest.raises(ValueError):
            reading.add(faulty, 0, 0)
            reading.row()


def test_only_the_wrapper_tells_menu_from_article(spark):
    """Two hosts whose class names mean nothing, and trade places."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    links = lambda: "".join(f"<span><a href=/{w}>{w}</a></span>" for w in say(5).split())
    rows, want = [], {}
    for k in range(24):
        title, parts, more = say(4), [say(30) for _ in range(rng.randint(1, 4))], say(3)
        menu, story = ("q1", "q2") if k % 2 else ("q2", "q1")
        html = f"<html><body><div class={menu}>{links()}</div><h1>{title}</h1><div class={story}>" + "".join(f"<p>{x}</p>" for x in parts) + f"</div><div class=q3>{more}</div><div class=q4>Always the same words here</div></body></html>"
        rows.append((k, f"http://h{k % 2}.example/{k}", html))
        want[k] = "\n".join([title, *parts])
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["matched"] for r in got.values())
    for k, _, html in rows[:4]:
        alone = html_extract.extract(html)[0]
        other = html_extract.extract(html, html_extract.wrapper_of([r[2] for r in rows if (r[0] - k) % 2][:6]))
        assert alone != want[k] and other == (alone, False)


def test_shards_against_all_cuts(spark):
    """Sizes, checksums, slots and the least possible largest shard, over cells in order of hash."""
    rng = random.Random(9)
    texts = [None, "", *("x" * rng.randint(0, 400) for _ in range(40)), *("y" * rng.randint(0, 900) for _ in range(30))]
    rows = [(k if k % 9 else None, t, 1, 2) for k, t in enumerate(texts)] + [(3, texts[3], 1, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, shard long")
    cell = {r["text"]: r["cell"] for r in df.select("text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - sharding.CELL_BITS).alias("cell")).collect()}
    size = lambda t: len((t or "").encode()) + 16
    sizes = {}
    for _, t, *_ in rows:
        sizes[cell[t]] = sizes.get(cell[t], 0) + size(t)
    ordered = [sizes[c] for c in sorted(sizes)]
    best = [0] + [10**9] * len(ordered)
    for _ in range(7):
        best = [min(max(best[j], sum(ordered[j:i])) for j in range(i + 1)) for i in range(len(ordered) + 1)]
    got = sharding.shard_documents(df, shards=7, per=3).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((k or 0, size(t), zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    load, slots, shard_of = {}, {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        shard_of.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(load.values()) == best[-1] and set(load) <= set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values())
    by_cell = sorted((cell[t], min(shard_of[zlib.crc32((t or "").encode())])) for _, t, *_ in rows)
    assert [s for _, s in by_cell] == sorted(s for _, s in by_cell)


def test_merges_agree_with_the_tokenizer():
    """Of all code points of three planes, odd white space, and long runs."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    encode = packing._encoder(tokenizer_path())
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}  {chr(c)} " for c in points[k : k + 400]) for k in range(0, len(points), 400)]
    rng = random.Random(2)
    odd = [*" \n\t\r\x0b\x0c\x1c\x85\xa0\u2028\u3000\u200baZé9½!…中🙂_\x00", "'s", "'", "'ll", "'RE", "e\u0301"]
    texts += ["".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(2000)] + [x * 60_000 for x in (" ", "x", "\n", " x", "1", "<|endoftext|>")] + [" \t" * 700_000 + "a"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:60]


def test_wrappers_learn_from_all_pages(spark):
    """Shapes and texts that a few pages of a host have, and pages of any length, count; samples missed them."""
    page = "<body><div><a>Home</a> <a>News</a></div><div>{}</div><div><p>Story {} of today says this.</p>{}</div>{}<div>All rights reserved here</div></body>"
    parts = ["<h2>x{}</h2>", "<h6>y{}</h6>", "<table><tr><td>z{}</table>", "<dl><dt>u{}</dl>", "<h3>v{}</h3>", "<ol><li>w{}</ol>", "<pre>t{}</pre>", "<h4>s{}</h4>", "<h5>r{}</h5>"]
    rows, want = [], {}
    for k in range(300):
        # Each ending is that of a few pages, and the line over the story differs on three.
        line = f"Correction {k}" if k in (77, 155, 233) else "A line of this host"
        more = parts[k // 5 % 9].format(k) if k % 5 == 0 else ""
        ending = "<ul>" + f"<li>long <b>{k}</b></li>" * (1100 if k == 50 else 1 + k % 3) + "</ul>"
        rows.append((k, f"http://h.example/{k}", page.format(line, k, more + ending, "")))
        want[k] = more, ending
    rows += [(1000 + k, "http://h.example/copy", rows[1][2]) for k in range(500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    assert len(got) == 800 and [k for k, r in got.items() if not r["matched"]] == []
    assert len(html_extract.tokens(rows[50][2])) > 4000
    for k, (more, ending) in want.items():
        lines = got[k]["text"].split("\n")
        assert lines[-1 - ending.count("<li>") - bool(more) :][0] == f"Story {k} of today says this." and "Home News" not in lines and "All rights reserved here" not in lines
        if more:
            assert re.sub("<[^>]*>", "", more) in lines
    assert all(got[1000 + k]["text"] == got[1]["text"] for k in range(500))
    # What the tasks noted and merged is what one place learns from all pages; copies of a page count once.
    nodes, texts, within = html_extract._loaded(html_extract.wrappers(df.select("page_id", "url", "html")).first()["wrapper"])
    assert [texts, within] == list(html_extract.learned(html_extract._tuples(nodes), [r[2] for r in rows]))
    constants = {t for some in texts for t in some}
    assert {"Home", "News", "All rights reserved here"} <= constants and "A line of this host" not in constants
