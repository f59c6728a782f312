import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandlens import storage
from demandlens.llm import chat, html_extract, langid, media, minhash, mixing, packing, quality, sharding, warc
from demandlens.llm.common import running_totals, scratch
from demandlens.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket long"
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def documents(spark):
    """Nulls, empty and long texts, copies, repeated rows, and clashing extra columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["th", "er", "an", "on", "in", "é"], k=rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(n)) for n in (60, 80, 120, 300, 4000)]
    near = base[3].split(" ")
    texts = [None, "", "  \n\t", "one", *base, base[1], base[1], " ".join(near[:-1] + ["other"]), "same same same " * 40, "ab\n" * 70, "x\u2028y " * 60]
    rows = [(k, t, "en" if k % 3 else None, [None, "a", "b"][k % 3], None, 7, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, base[0], None, None, None, None, None)], DOCS), texts


def test_running_totals(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 40).alias("b"), "id", F.lit(2).alias("v"))
    got = running_totals(df, ["k"], "b", ["id"], {"v": "before"}).toPandas().sort_values(["k", "b", "id"])
    assert (got.groupby("k")["v"].cumsum() - got["v"] == got["before"]).all()


def test_minhash_against_brute_force(spark):
    df, texts = documents(spark)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, shingle=2).collect()}
    sets = {}
    for k, t in enumerate(texts):
        w = words_of((t or "").lower())
        sets[k] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(map(tuple, [w] if w else []))
    for k, s in sets.items():
        linked = [j for j, o in sets.items() if s and o and 100 * len(s & o) >= 80 * len(s | o)]
        assert got[k]["n_shingles"] == len(s)
        assert got[k]["component_id"] == min([k, *linked]) and got[k]["kept"] == (got[k]["component_id"] == k)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_chain_and_large_group(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows, text = [], list(base)
    for k in range(60):  # neighbours are alike, the ends are not
        rows.append((k, " ".join(text), "x"))
        text[k * 3] = f"new{k}"
    rows += [(1000 + k, " ".join([*base[:-1], f"tail{k}"]), "x") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["component_id"] for r in minhash.near_duplicates(df, shingle=2).collect()} == {0}


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (200, 100), (7, 7)]
    got = {r["id"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100, 200: 100}


def test_packing_covers_every_token(spark):
    df, texts = documents(spark)
    rows = packing.pack(df, tokenizer_path()).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["uid"]), []).append(r)
    assert len(by) == len(texts) + 2
    for (doc, _), pieces in by.items():
        whole = b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"]))
        ids = t.encode(texts[doc if doc is not None else 4] or "", add_special_tokens=False).ids + [0]
        assert whole == b"".join(i.to_bytes(4, "little") for i in ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_solver_never_exceeds_the_histogram():
    import numpy as np

    h = np.zeros(1025, np.int64)
    h[[700, 300, 24, 512, 1, 1023]] = [50, 60, 55, 9, 3, 3]
    combos, repeats = packing.solve(1024, h)
    used = np.zeros_like(h)
    for c, n in zip(combos, repeats, strict=True):
        assert c.sum() == 1024
        for x in c[c > 0]:
            used[x] += n
    assert (used <= h).all() and repeats.sum() == 50 + 4 + 3


def test_mixing(spark):
    df, texts = documents(spark)
    got = mixing.mix(df, block=8, shards=5).taken().toPandas()
    assert len(got) == len(texts) + 2 and (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(df, block=8, shards=5).taken().toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.targets({"a": 10, "b": 100, None: 0}) == {"a": 20.0, "b": 145.0, None: 0.0}
    mixed = mixing.mixed_documents(df, block=8, shards=5).collect()
    assert sum(len(words_of(r["text"])) for r in mixed) == got["taken"].sum()
    assert mixing.mix(df.limit(0)).taken().count() == 0


def test_quality_against_brute_force(spark):
    df, texts = documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(df, labels).collect()}
    for k, t in enumerate(texts):
        w = words_of(t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        r = got[k]
        want = (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(marked), len(w) < 50 or 2 * len(marked) > len(w))
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert r["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")
    # Filters on the lazy result are planned as they stand.
    out = quality.quality_rules(df, labels.limit(0))
    assert out.filter("kept").count() == out.filter("not base_failed").count() == sum(not r["base_failed"] for r in out.collect())
    assert out.filter("n_words > 3 and kept and llr = 0").groupBy("n_dup_lines").count().count() > 0
    assert quality.quality_rules(df.limit(0), labels).collect() == []


@pytest.mark.parametrize("n", [40, 400])
def test_quality_rejects_junk_at_every_size(spark, n):
    """llr and kept against brute force; a fixed prior let all junk of so few words pass."""
    import math

    rng = random.Random(n)
    good = ["".join(rng.choices("abcdef", k=4)) for _ in range(150)]
    texts = {k: " ".join(rng.choices(good, k=rng.randint(60, 120)) if k % 4 else [w + rng.choice(["###", "$$$", "%%%"]) for w in rng.choices(good, k=80)]) for k in range(n)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = {k: (int(k % 4 > 0), 0) for k in texts if k % 4 < 3}
    buckets = 1 << 12
    got = {r["doc_id"]: r for r in quality.quality_rules(df, spark.createDataFrame([(k, *v) for k, v in labels.items()], "doc_id long, quality int, toxic int"), buckets).collect()}
    h = F.xxhash64("a")
    paired = {k: list(zip(w, [*w[1:], None], strict=True)) for k, t in texts.items() for w in [t.split(" ")]}
    pairs = {p for x in paired.values() for p in x}
    hashed = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", h.alias("x"), F.xxhash64(h, F.when(F.col("b").isNotNull(), F.xxhash64("b"))).alias("y")).collect()
    bucket = {(r["a"], r["b"]): (r["x"] % buckets, r["y"] % buckets) for r in hashed}
    grams = {k: [g for p in x for g in bucket[p]] for k, x in paired.items()}
    raw, one = Counter(g for x in grams.values() for g in x), [k for k, v in labels.items() if v[0]]
    trusted = Counter(g for k in one for g in grams[k])

    def score(x, own=()):
        mine = Counter(own)
        g = sum(trusted.values()) - len(own)
        weight = lambda b: round(1e4 * math.log((trusted[b] - mine[b] + g / 16 * (p := (raw[b] + 1) / (sum(raw.values()) + buckets))) / (g + g / 16) / p))
        return sum(map(weight, x)) / 1e4 / len(x)

    held = sorted(score(grams[k], grams[k]) for k in one)
    at = (len(held) - 1) * 0.01
    level = min(-0.09, held[int(at)] + (at - int(at)) * (held[int(at) + 1] - held[int(at)]))
    for k, x in grams.items():
        assert got[k]["llr"] == pytest.approx(score(x), abs=1e-5)
        assert got[k]["kept"] == (not got[k]["base_failed"] and score(x) >= level)
        if k % 4 == 0 or k in one:
            assert got[k]["kept"] == (k % 4 > 0)


def test_language(spark):
    rows = [(k, ("the thing and then " if k % 2 else "der die und nicht ") * 20, "en" if k % 2 else "de") for k in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(train)
    asked = spark.createDataFrame([(1, "then the thing"), (2, "nicht die"), (3, None), (4, ""), (5, "12 34 !"), (6, "and then " * 50000)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(asked, samples).orderBy("doc_id").collect()] == ["en", "de", "und", "und", "und", "en"]
    assert langid.identify(asked, ()).filter("lang_pred <> 'und'").count() == 0
    moves = langid.suffix_automaton(b"abcbc")
    for s in (b"bcb", b"cbc", b"abcbc"):
        state = 0
        for c in s:
            state = moves[state][c]
    assert ord("a") not in moves[moves[0][ord("b")]]


def test_gif_round_trip():
    rng = random.Random(5)
    for n in (576, 576 * 3, 576 * 130):
        data = bytes(rng.choices(b"abc \xff\x00", k=n))
        frames = list(media.decode(media.encode(data)))
        assert b"".join(f.indices for f in frames) == data and [f.time_ms for f in frames] == [100 * k for k in range(len(frames))]
        assert sum(sum(media.colours(f.canvas)) for f in media.decode(media.encode(b"ab" * 288))) == 3 * 576
        assert len(media.lzw_encode(data)) < 9 * len(data) // 8
    with pytest.raises(ValueError):
        list(media.decode(b"PNG"))


def deferred(data, bits, again=None):
    """An LZW stream whose table stays full; a clear code comes only after `again` more codes, if at all."""
    clear, out, at = 1 << bits, 0, 0
    width, table, w, late = bits + 1, {}, b"", 0

    def emit(code):
        nonlocal out, at
        out |= code << at
        at += width

    def fresh():
        return {bytes([k]): k for k in range(clear)}

    emit(clear)
    table, size = fresh(), clear + 2
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        emit(table[w])
        if size < 4096:
            table[w + bytes([b])] = size
            size += 1
            width = max(width, (size - 1).bit_length())
        else:
            late += 1
            if late == again:
                emit(clear)
                table, size, width, late = fresh(), clear + 2, bits + 1, 0
        w = bytes([b])
    emit(table[w])
    emit(clear + 1)
    return out.to_bytes(-(-at // 8), "little")


@pytest.mark.parametrize("bits", [2, 8])
@pytest.mark.parametrize("again", [None, 5, 4096, 9000])
def test_lzw_with_a_late_clear_code(bits, again):
    data = bytes(random.Random(bits).choices(range(1 << bits), k=60_000 if bits == 8 else 200_000))
    assert media.lzw_decode(deferred(data, bits, again), bits, len(data)) == data
    assert media.lzw_decode(deferred(data, bits, again), bits, 50_001) == data[:50_001]


def test_gif_disposal_and_transparency():
    import struct

    palette = bytes([255, 0, 0, 0, 255, 0])
    frame = lambda disposal, transparent, data: b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + struct.pack("<H", 5) + bytes([transparent or 0, 0]) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 1, 0) + b"\x08" + media._chunks(media.lzw_encode(data))
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + palette + frame(1, None, b"\0\0") + frame(3, 1, b"\0\1") + frame(2, None, b"\1\1") + frame(0, 0, b"\0\1") + b"\x3b"
    shown = [f.canvas[0].tolist() for f in media.decode(gif)]
    red, green, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    assert shown == [[red, red], [red, red], [green, green], [clear, green]]


def test_media_frames_as_shown(spark):
    import struct

    palette = bytes([200, 0, 0, 0, 102, 0])  # of one luminance
    frame = lambda disposal, transparent, left, data: b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + struct.pack("<H", 5) + bytes([transparent or 0, 0]) + b"\x2c" + struct.pack("<HHHHB", left, 0, len(data), 1, 0) + b"\x08" + media._chunks(media.lzw_encode(data))
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + palette + frame(1, None, 0, b"\0\0") + frame(3, None, 1, b"\1") + frame(2, 1, 0, b"\1\1") + frame(0, 0, 0, b"\0\1") + b"\x3b"
    r, g, none = bytes([200, 0, 0, 255]), bytes([0, 102, 0, 255]), bytes(4)
    want = [r + r, r + g, r + r, none + g]
    row = media.read_media(spark.createDataFrame([(1, 2, bytearray(gif))], "doc_id long, n_bytes long, media binary")).first()
    for f, pixels in zip(row["frames"], want, strict=True):
        opaque = [p for p in (pixels[:4], pixels[4:]) if p[3]]
        assert (f["width"], f["height"], f["time_ms"]) == (2, 1, 50 * f["index"])
        assert f["histogram"] == [sum(p[c] >> 4 == k for p in opaque) for c in range(3) for k in range(16)]
        assert bytes(f["pixels"]) == pixels


def test_media_of_texts(spark):
    df, texts = documents(spark)
    got = {r["doc_id"]: r for r in media.read_media(media.store_texts(df)).collect()}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        b += b"\xff" * (-len(b) % 576 or (0 if b else 576))
        assert got[k]["payload_bytes"] == len(b) and got[k]["tail_crc32"] == zlib.crc32(b[-32:])


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><a>menu</a></nav><div class=ad>buy</div><article><h1>A &amp; B</h1><p><b>one.<br><p>two  <i>three</i></p>{}<section class='comments'><p>nice!</p></section></article><footer>end</footer></body></html>"
    assert html_extract.extract(page.format(""))[0] == "A & B\none.\ntwo three"
    rows = [(k, "http://h.example/x", page.format("<p>more</p>" * (k % 3))) for k in range(12)] + [(20, None, None), (21, "bad", ""), (22, "http://i.example", "<p>a<aside>b</aside>")]
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 15 and got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "a"
    assert got[2]["text"] == "A & B\none.\ntwo three\nmore\nmore" and got[2]["n_chars"] == len(got[2]["text"])
    assert sum(r["matched"] for r in got.values()) >= 10


def test_wrapper_inference():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><p>y</p>", "<ul><li>d</li><li>e</li><li>f</li></ul><h2>z</h2><p>x</p>"]
    kinds = [n[0] for n in html_extract.infer(pages)]
    assert "+" in kinds and "?" in kinds


def test_wrapper_leaves_out_constant_blocks(spark):
    page = "<body><div><a>Home</a> <a>News {0}</a></div><div><a>Home</a> | <a>News</a></div><div>We use <b>cookies</b>.</div><div><p>Story {0} says <b>this</b>.</p><p>Part {1}</p></div>{2}<div>All rights reserved</div></body>"
    rows = [(k, "http://h.example/x", page.format(k, k % 7, "<ul><li>more</li></ul>" * (k % 2))) for k in range(40)] + [(50, "http://i.example", page.format(1, 1, ""))]
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(40):
        lines = got[k]["text"].split("\n")
        assert got[k]["matched"] and lines == [f"Story {k} says this.", f"Part {k % 7}"]
    # A single page has no constants and no region.
    assert "Home | News" in got[50]["text"] and "All rights reserved" in got[50]["text"]
    wrapper = html_extract.wrapper_of([r[2] for r in rows[:6]])
    other = page.format(9, 9, "").replace("</p></div>", "</p>All rights reserved</div>")
    assert html_extract.extract(other, wrapper)[0].startswith("Home News 9")  # not matched, so by its own elements
    # An article element vouches for its text.
    alike = "<body><div>menu</div><article><h1>Same head</h1><p>text {}</p></article></body>"
    assert html_extract.extract(alike.format(9), html_extract.wrapper_of([alike.format(k) for k in range(6)])) == ("Same head\ntext 9", True)


def test_sharding(spark):
    df, texts = documents(spark)
    got = sharding.shard_documents(df, shards=4, per=2).toPandas()
    assert len(got) == len(texts) + 2
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    rng = random.Random(2)
    for _ in range(200):
        sizes, n = [rng.randint(1, 50) for _ in range(rng.randint(1, 30))], rng.randint(1, 8)
        best = [0] + [10**9] * len(sizes)
        for _ in range(n):
            best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
        assert sharding.smallest_capacity(sizes, n) == best[-1]
        loads = Counter()
        for s, x in zip(sharding.assign(sizes, n), sizes, strict=True):
            loads[s] += x
        assert max(loads.values()) == best[-1] and max(loads) < n
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_warc(spark):
    rows = spark.createDataFrame([(1, "http://a/ b\r\nX: y", b"one"), (2, None, b"one"), (3, "u", b""), (5, "u", b""), (4, "u", bytes(range(256)) * 3000), (2, None, b"one")], "id long, target_uri string, payload binary")
    path = scratch(spark, "test")
    warc.write_archives(warc.with_revisits(rows), path)
    got = {(r["record_id"], r["record_type"]): r for r in warc.read_archives(spark, path).collect()}
    assert bytes(got["<urn:page:4>", "response"]["payload"]) == bytes(range(256)) * 3000
    assert got["<urn:page:1>", "revisit"]["refers_to"] == "<urn:page:2>" and got["<urn:page:3>", "revisit"]["refers_to"] == "<urn:page:5>"
    only = warc.read_archives(spark, path).filter("record_type = 'revisit'")
    assert only.count() == 2 and warc.read_archives(spark, path, payload=False).filter("payload is not null").count() == 0
    import base64
    import hashlib
    import io

    digest = warc.read_archives(spark, path).filter("record_id = '<urn:page:2>'").first()["payload_digest"]
    assert digest == "sha1:" + base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    plain = b"".join(warc.record_bytes({"record_id": f"<{k}>", "record_type": "resource", "payload": b"p%d" % k}) for k in range(3))
    assert [b for _, b in warc.read_records(io.BytesIO(plain), lambda h: h["WARC-Record-ID"] != "<1>")] == [b"p0", b"p2"]


def test_chat(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "\\</s>\\\\", "<<|end|>|turn|>", "<|image:0|>", "a\\", "<\\/s>"]
    for t in nasty:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
    flat = chat.PartVisitor().visit([{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 56, "height": 29}, {"type": "document", "ref": "d", "pages": 2}])
    assert flat.text == "see <|image:0|><|document:1|>" and flat.attachments == [("image", "i.png", 4), ("document", "d", 1200)] and flat.tokens == 1204
    with pytest.raises(ValueError):
        chat.PartVisitor().visit([{"type": "video"}])
    rows = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(nasty)] + [(2, None, None, None), (2, None, None, None), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(rows)).collect()}
    import hashlib

    assert got[1]["loss_sha256"] == hashlib.sha256("".join(nasty[::2]).encode()).hexdigest() and got[1]["loss_chars"] == sum(map(len, nasty[::2]))
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(rows.limit(0))).count() == 0


def test_quality_learns_from_all_trusted_documents(spark):
    """Counts and threshold against brute force over more than 1000 trusted documents; a sample of them missed the odd ones."""
    import math

    rng = random.Random(3)
    usual, odd = (["".join(rng.choices(x, k=3)) for _ in range(60)] for x in ("abcdef", "uvwxyz"))
    texts = {k: " ".join(rng.choices(odd if k % 43 == 0 else usual, k=rng.randint(50, 60))) for k in range(2600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 13 > 0 or k % 43 == 0), 0) for k in texts] + [(k, 1, 0) for k in range(5000, 30000)], "doc_id long, quality int, toxic int")
    one = [k for k in texts if k % 13 or k % 43 == 0]
    assert quality.trusted_ids(labels).count() == len(one) + 25000
    trusted = quality.trusted_texts(docs, labels)
    assert sorted(r["text"] for r in trusted.collect()) == sorted(texts[k] for k in one)
    buckets = 1 << 10
    counts = quality.bucket_counts(docs, trusted, buckets)
    row = counts.first()
    assert (row["n"], row["g"]) == tuple(sum(2 * len(texts[k].split()) for k in some) for some in (texts, one))
    pairs = {(a, b) for t in texts.values() for a, b in zip(t.split(), [*t.split()[1:], None], strict=True)}
    h = F.xxhash64("a")
    hashed = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", h.alias("x"), F.xxhash64(h, F.when(F.col("b").isNotNull(), F.xxhash64("b"))).alias("y")).collect()
    bucket = {(r["a"], r["b"]): (r["x"] % buckets, r["y"] % buckets) for r in hashed}
    n, g = row["n"], row["g"]

    def held(text):
        w = text.split()
        own = Counter(x for p in zip(w, [*w[1:], None], strict=True) for x in bucket[p])
        m = 2 * len(w)
        weight = lambda b, c: round(1e4 * math.log((row["good"][b] - c + g / 16 * (p := (row["raw"][b] + 1) / (n + buckets))) / (g - m + g / 16) / p))
        return sum(c * weight(b, c) for b, c in own.items()) / 1e4 / m

    scores = sorted(held(texts[k]) for k in one)
    at = (len(scores) - 1) * quality.BELOW
    want = scores[int(at)] + (at - int(at)) * (scores[int(at) + 1] - scores[int(at)])
    assert quality.held_out_level(trusted, counts, row, buckets) == pytest.approx(want, abs=3e-6)


def test_few_edges_are_united_in_one_task(spark, monkeypatch):
    """Either way, and both in turn, against brute force; few edges took as many joins and exchanges as many before."""
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(500 + k, 501 + k) for k in range(60)]
    rng.shuffle(edges)
    want = {k: k for e in edges if e[0] != e[1] for k in e}
    while any(want[a] != want[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    turns = []
    for few in (10**6, 40, 0):
        monkeypatch.setattr(minhash, "FEW", few)
        made = []
        monkeypatch.setattr(minhash, "materialise", lambda d, name, f=storage.materialise: made.append(name) or f(d, name))
        assert {r["id"]: r["root"] for r in minhash.components(df).collect()} == want
        turns.append(made.count("parents"))
    assert turns[0] == 1 < turns[1] < turns[2]
    assert minhash.components(df.limit(0)).count() == 0
