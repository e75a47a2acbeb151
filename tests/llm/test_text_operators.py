"""Quality, sharding, extraction, SentencePiece, licences, packing and the pipeline."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termweave.llm import html_extract, license_scan, packing, quality, sentencepiece, sharding
from termweave.llm.common import table
from termweave.llm.html_blocks import blocks
from termweave.llm.piece_model import BPE, NORMAL, UNIGRAM, UNKNOWN, PieceModel
from termweave.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


# --- quality --------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    rows = quality.classify(spark, table(spark, sf, "documents"), labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert np.mean([r["predicted"] == 1 for r in held if r["quality"] == 1]) > 0.9


def test_quality_scores_do_not_depend_on_neighbours():
    net = quality.fit([b"good text here. " * 9, b"BAD!! BAD!! " * 9] * 8, np.arange(16), np.array([1, 0] * 8))
    t = [b"", b"a", b"good text. " * 200, b"BAD!! " * 3000, b"x" * 511, b"y" * 513]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in t])])
    together = net.scores(np.frombuffer(b"".join(t), np.uint8), offs)
    alone = [net.scores(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in t]
    assert np.allclose(together, alone, atol=1e-6)
    assert together[2] > 0.5 > together[3]


def test_quality_sees_the_end_of_a_long_text():
    net = quality.fit([b"good text here. " * 9, b"BAD!! BAD!! " * 9] * 8, np.arange(16), np.array([1, 0] * 8))
    a, b = b"good text here. " * 4000, b"good text here. " * 4000 + b"BAD!! BAD!! " * 40
    sa, sb = (net.scores(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in (a, b))
    assert sb < sa


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(spark, docs, labels).collect()
    assert [r["score"] for r in got] == [0.5] * 3 and all(r["predicted"] == 1 for r in got)
    assert quality.classify(spark, docs.limit(0), labels).count() == 0


# --- sharding -------------------------------------------------------------------------------------


def test_shards(spark):
    rng = np.random.RandomState(0)
    rows = [(int(i), "é" * int(rng.randint(0, 300))) for i in rng.permutation(500)] + [(None, "x"), (7, None), (7, None)]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)), 8).collect()
    assert len(got) == len(rows)
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(load) - min(load) <= 2 * (600 + 16)
    for s in range(8):
        own = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == sorted(x[1] for x in own)
    last = [max(-1 if r["doc_id"] is None else r["doc_id"] for r in got if r["shard"] == s) for s in range(8)]
    assert last == sorted(last)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 7 and r["size"] == 16} == {(16, 0)}


def test_more_shards_than_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    got = sharding.byte_shards(df, 40).collect()
    assert len({r["shard"] for r in got}) == 2 and all(r["slot"] == 0 for r in got)
    assert sharding.byte_shards(df.limit(0), 40).count() == 0


# --- extraction -----------------------------------------------------------------------------------


def labels_cost(gain, ties, labels):
    return sum(abs(g) for g, x in zip(gain, labels) if (g > 0) != x) + sum(c for a, b, c in ties if labels[a] != labels[b])


def test_min_cut_is_minimal():
    rng = np.random.RandomState(0)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = rng.randn(n).round(2).tolist()
        ties = [(int(a), int(b), float(rng.rand().__round__(2))) for a, b in rng.randint(0, n, (rng.randint(0, 14), 2)) if a != b]
        best = min(labels_cost(gain, ties, [bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(labels_cost(gain, ties, html_extract.min_cut(gain, ties)) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="content">
<header><h1>Site</h1><a href=x>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies. OK?</div><script>var a = "</p><p>no";</script><!-- <p>no</p> -->
<article><header><h1>The&nbsp;title &amp;amp; more</h1></header><p>First   long
paragraph with <b>bold</b> words&hellip;<p>Second one, with <a href=q>a link</a> in it.<br>Next line.
<div class="ad">Buy now!</div><aside>Related things</aside><p>Third paragraph ends here.</p>
<section id="comments"><p>Nice article, thanks a lot!</p></section></article>
<form>Search <input><button>Go</button></form><footer>&copy; us</footer>"""


def test_extraction_of_a_page(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (5, "x", "<nav><a href=1>x</a></nav>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract_text(df).collect()}
    want = "The title &amp; more\nFirst long paragraph with bold words…\nSecond one, with a link in it. Next line.\nThird paragraph ends here."
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert all((got[i]["text"], got[i]["n_chars"]) == ("", 0) for i in (2, 3, None, 5))
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_broken_markup_is_read_to_the_end():
    assert [b.text for b in blocks('<p>a<p title="x>b<p>c')][0] == "a"
    assert [b.text for b in blocks("<p>a<script>x")] == ["a"]
    assert [b.text for b in blocks("<p>a<!-- x <p>b")] == ["a"]
    assert [b.text for b in blocks("a < b <i>c</i>d</p></div>e")] == ["a < b cd", "e"]
    assert len(blocks("<div>" * 3000 + "x")) == 1


def test_article_text_in_odd_markup_stays():
    def text(html):
        page = blocks(html)
        return [b.text for b, keep in zip(page, html_extract.content(page, html_extract.PRIOR)) if keep]

    long = "This sentence was written for this page and has quite a few words in it."
    assert [b.text for b in blocks("<p>One <button>x<p>Rest of it.")] == ["One x", "Rest of it."]
    assert [b.text for b in blocks("<p>One <button>x</button> two <svg><title>t</title></svg>three <select><option>a</select>.")] == ["One two three ."]
    assert [b.text for b in blocks("<p>a <svg>b <p>c <object>d<p>e</object>")] == ["a b", "c"]
    assert [b.text for b in blocks("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, R&am<b>p;</b>x &amp<i>;</i>")] == ["If x=2 holds, R&amp;x &;"]
    assert text(f'<article><h1>Head</h1><p>{long}</p><section class="legal-history"><p>{long}</p></section><p class="side-by-side">{long}</p><blockquote class="share">{long}</blockquote></article>') == ["Head", long, long, long, long]
    assert text(f'<article><p>{long}</p><div class="share-buttons">Share this on the net.</div><div class="adBox">Buy it.</div><ul class="related-links"><li>More</li></ul><section id="comments"><p>{long}</p></section></article>') == [long]
    assert text(f"<body><nav><a href=1>Home</a></nav><h1>Head line</h1><p>{long}</p><h2>Part</h2><p>{long}</p><footer>Us</footer>") == ["Head line", long, "Part", long]
    assert text(f"<body><div><h2>Part</h2><div><p>{long}</p><p>{long}</p></div></div><div id=sidebar><p>Other things.</p></div>") == ["Part", long, long]


def test_deep_pages_take_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        assert len(html_extract.content(blocks("<div>x" * n), html_extract.PRIOR)) == n
        return time.perf_counter() - began

    assert took(20000) < 20 * took(4000) + 1


def test_labels_do_not_look_at_markup():
    pages = [["Home", "About us", f"Page {i} has a text of its own with far more than the fifteen words that it takes to be one."] for i in range(3)]
    assert html_extract.weak_labels(pages) == [[0, 0, 1]] * 3


def test_extraction_of_whole_table(spark):
    import html
    import re

    rows = html_extract.extract_text(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)


# --- SentencePiece --------------------------------------------------------------------------------


ODD_TEXTS = [(9000, "Hello  world\n\tä 漢字  x "), (9001, "▁a b ▁▁"), (9002, ""), (9003, None), (9004, " " * 40 + "x"), (9005, "e" * 70 + "thethetheation" * 200), (9006, "a\x00b 😀é߿ࠀ￿𐀀"), (None, "  lead"), (9000, "again"), (9007, "=" * 33 + " " + "-" * 64 + "e" * 65)]


def test_bpe_ids_equal_the_library(spark):
    import sentencepiece as lib

    path = tokenizer_file("piece_bpe_32k.model")
    sp = lib.SentencePieceProcessor(model_file=path)
    docs = table(spark, SF, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")).withColumn("ids", F.lit("clash"))
    coded = sentencepiece.encode(docs, path, keep=["text", "doc_id"])
    rows = sentencepiece.decode(coded, path, keep=["doc_id", "text", "n_ids", "ids"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = sp.encode(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_ids"] == len(ids)
        assert r["decoded"] == sp.decode(ids)
    both = sentencepiece.encode(docs, path, keep=["ids"], decoded=True)
    assert both.columns == ["ids", "n_ids", "ids", "decoded"] and sorted(r[3] for r in both.collect()) == sorted(r["decoded"] for r in rows)
    assert sentencepiece.encode(docs.limit(0), path).count() == 0


def as_proto(model):
    """A model file of the pieces, without normalization."""

    def field(n, data):
        return bytes([n << 3 | 2]) + bytes([len(data) & 127 | 128, len(data) >> 7]) + data

    pieces = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, t])) for p, s, t in model.pieces)
    return pieces + field(2, bytes([0x18, model.kind, 35 << 3 & 127 | 128, 35 >> 4, 1])) + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


def test_best_path_equals_the_library(spark):
    import sentencepiece as lib

    model = PieceModel.load(tokenizer_file("piece_bpe_32k.model")).as_unigram()
    sp = lib.SentencePieceProcessor(model_proto=as_proto(model))
    # The library adds up scores in single precision over a whole text: short ones, or its sums are rounded.
    docs = table(spark, SF, "documents").select("doc_id", F.explode(F.split("text", "[.] ")).alias("text"))
    docs = docs.where("length(text) < 300").unionAll(spark.createDataFrame([x for x in ODD_TEXTS if len(x[1] or "") < 300], "doc_id long, text string"))
    rows = sentencepiece.encode(docs, model, keep=["text"]).collect()
    assert len(rows) > 1000 and len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == sp.encode(r["text"] or "")


def plain_codes(model, unit):
    """Merges one at a time, the best piece first, or the best of all paths."""
    table = {p: (i, s) for p, i, s in model.vocabulary}
    if model.kind == BPE:
        parts = list(unit)
        while True:
            fit = [(-table[a + b][1], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table]
            if not fit:
                break
            i = min(fit)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    else:
        floor = min(s for _, s in table.values()) - 10
        best = [(0.0, [])] + [None] * len(unit)
        for j in range(1, len(unit) + 1):
            for i in range(j):  # the earlier start stays where sums are equal
                s = table[unit[i:j]][1] if unit[i:j] in table else floor if j == i + 1 else None
                if s is not None and (best[j] is None or np.float32(best[i][0] + np.float32(s)) > best[j][0]):
                    best[j] = (np.float32(best[i][0] + np.float32(s)), [*best[i][1], unit[i:j]])
        parts = best[-1][1]
    return [table[p][0] if p in table else model.unknown for p in parts]


def test_blocks_are_cut_once_and_their_memory_is_given_back(monkeypatch):
    import pyarrow as pa

    from termweave.llm.blocks import packed

    model = PieceModel.load(tokenizer_file("piece_bpe_32k.model"))
    cutter = sentencepiece.Cutter(model)
    texts = [["a b c", None, "zz the a", ""], ["a", "a a"], ["rare words again " * 50_000, "the b 水"]]
    ids_of = lambda u: [7 + sum(u.encode())] * (1 + len(u) % 3)
    units = [[u for _, us, which, _ in cutter.slices(pa.array([t], pa.string())) for u in (us[w] for w in which)] for ts in texts for t in ts]
    common = [units[0][0], *units[4]]  # all of the second block are common
    common = list(dict.fromkeys(common))
    known = sentencepiece.Known({}, np.zeros(0, "<u4"), np.zeros(1, np.int64))
    known = sentencepiece.Known({u: i for i, u in enumerate(common)}, *known.laid(pa.array(map(ids_of, common), pa.list_(pa.int32()))))
    blobs = [packed(pa.record_batch([pa.array(t, pa.string())], ["t"])) for t in texts]

    calls = {"cut": 0, "release": 0}
    cut, give_back = sentencepiece.Cutter.slices, sentencepiece.release
    monkeypatch.setattr(sentencepiece.Cutter, "slices", lambda *a: calls.update(cut=calls["cut"] + 1) or cut(*a))
    monkeypatch.setattr(sentencepiece, "release", lambda: calls.update(release=calls["release"] + 1) or give_back())
    asked = list(sentencepiece._distinct_units(model, known)(iter([pa.record_batch([pa.array([0, 1, 2]), pa.array(blobs)], ["block", "payload"])])))
    assert calls == {"cut": 3, "release": 3}
    rows = [r for b in asked for r in b.to_pylist()][::-1]
    assert not any(r["block"] == 1 or r["key"] in common for r in rows)
    kind = pa.list_(pa.struct([("place", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    answers = pa.array([[{"place": r["place"], "ids": ids_of(r["key"])} for r in rows if r["block"] == k] or None for k in range(3)], kind)
    calls.update(cut=0, release=0)
    out = [r for b in sentencepiece._assemble(model, True, False, known)(iter([pa.record_batch([pa.array(blobs), answers], ["payload", "answers"])])) for r in b.to_pylist()]
    assert calls == {"cut": 3, "release": 3}  # a block was cut twice before
    assert [r["t"] for r in out] == [t for ts in texts for t in ts]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in out] == [[i for u in us for i in ids_of(u)] for us in units]
    assert [r["n_ids"] for r in out] == [len(r["ids"]) // 4 for r in out]


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
def test_lattice_equals_the_plain_encoder(spark, kind):
    rng = np.random.RandomState(4)
    pieces = [("<unk>", 0.0, UNKNOWN)] + [(c, -5.0 - i / 7, NORMAL) for i, c in enumerate("abc▁")]
    while len(pieces) < 40:  # as they are learned: each piece joins two better ones
        one, two = (pieces[1 + rng.randint(len(pieces) - 1)][0] for _ in range(2))
        more = [*pieces, (one + two, -10.0 - len(pieces) if kind == BPE else -round(rng.rand(), 3) * 9, NORMAL)]
        if one + two not in {p for p, _, _ in pieces} and len(one + two) < 30:
            try:
                PieceModel(more, kind, True).ranked()
                pieces = more
            except ValueError:
                pass
    model = PieceModel(pieces, kind, True)
    units = {"".join(rng.choice(list("abcd"), rng.randint(1, 14))) for _ in range(150)} | {"".join(rng.choice(list("abcd"), n, p=[0.4, 0.3, 0.25, 0.05])) for n in (31, 32, 33, 63, 64, 65, 96, 128, 129, 500)}
    df = spark.createDataFrame([(sentencepiece.unit_key(u), u if len(u) > 64 else None) for u in units], "key string, long string")
    got = {r["key"]: r["ids"] for r in sentencepiece.encode_units(df, model).collect()}
    assert got == {sentencepiece.unit_key(u): plain_codes(model, u) for u in units}


# --- licences -------------------------------------------------------------------------------------


def test_license_notices(spark):
    lines = [
        (1, "some text\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "This library is licensed under the GNU Lesser General Public License, version 2.1."),
        (4, "Released under the MIT License."),
        (5, "words before it Licensed under CC BY-NC 4.0. and after"),
        (6, "Released under the Example Community License, version 1.0."),
        (7, "The general public left the garden under the old version of the bridge.\nNothing here."),
        (8, None),
        (None, "Licensed under CC BY 4.0."),
        (10, ""),
    ]
    df = spark.createDataFrame(lines, "doc_id long, text string").withColumn("family", F.lit("x"))
    got = {r["doc_id"]: (r["paragraph"], r["family"], r["confirmed"]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: (1, "apache", True), 2: (0, "gpl", True), 3: (0, "lgpl", True), 4: (0, "mit", True), 5: (0, "cc-by-nc", True), 6: (0, "unknown", False), None: (0, "cc-by", True)}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_notices_over_several_lines(spark):
    import textwrap

    families = license_scan.FAMILIES
    mit, bsd = families["mit"][2], families["bsd"][1:4]
    lines = [
        (1, "Copyright someone\n\n" + textwrap.fill(mit, 72)),
        (2, "\n\n".join(textwrap.fill(t, 72) for t in bsd)),
        (3, "\n".join(" * " + x for x in textwrap.wrap(families["gpl"][1], 40))),
        (4, textwrap.fill(families["lgpl"][1], 72)),
        (5, textwrap.fill(families["isc"][0], 72)),
        (6, textwrap.fill(families["apache"][2], 72)),
        (7, textwrap.fill(families["proprietary"][0], 72)),
        (8, textwrap.fill(mit, 72).replace("\n", "\n\n")),
        (9, textwrap.fill("The house was old and the garden was wide. " + mit, 72)),
    ]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    got: dict[int, list] = {}
    for r in license_scan.scan_licenses(df).collect():
        got.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"], r["confirmed"]))
    starts = [0]
    for t in bsd[:2]:
        starts.append(starts[-1] + len(textwrap.wrap(t, 72)) + 1)
    assert got[1] == [(2, "mit", True)]
    assert sorted(got[2]) == [(i, "bsd", True) for i in starts]
    assert [got[i] for i in (3, 4, 5, 6, 7, 9)] == [[(0, f, True)] for f in ("gpl", "lgpl", "isc", "apache", "proprietary", "mit")]
    assert not any(sure for _, _, sure in got.get(8, []))  # lines apart aren't one paragraph


def test_license_scan_on_the_table(spark):
    docs = table(spark, SF, "documents")
    got = {(r["doc_id"], r["paragraph"]) for r in license_scan.scan_licenses(docs).collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, line in enumerate(r["text"].split("\n")) if "icense" in line}
    assert got == want


# --- packing --------------------------------------------------------------------------------------


def check_packing(rows, window):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return len(by)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    extra = [(9000, ""), (9001, None), (9002, "a  b   c \n\n d"), (9003, "x <|endoftext|> y"), (9004, "word " * 9000), (None, "no id"), (9000, "")]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.pack(docs, path, with_ids=True).collect()
    n = check_packing(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert n * 2048 < total * 1.1 + 2048
    tok = Tokenizer.from_file(path)
    pieces: dict[tuple, list] = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces[r["doc_id"]] if p["doc_tokens"] == len(ids)), key=lambda p: p["start"])
        assert own[0]["start"] == 0
        if r["doc_id"] != 9000:
            got = b"".join(p["ids"] for p in own)
            assert np.frombuffer(got, "<u4").tolist() == ids
        assert all(p["ids_crc32"] == zlib.crc32(p["ids"]) for p in own)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_ids_of_mixed_white_space_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    bpe, tok = packing.FastBpe(path), Tokenizer.from_file(path)
    blanks = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2003\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
    rng = np.random.RandomState(6)
    texts = ["price: \xa0 \xa0 5 euros", "\xa0 a", " \xa0 ", "a\xa0 b \xa0c"]
    texts += [f"one{a} {b}two{b} {a} 3" for a in blanks for b in blanks]
    texts += ["".join(rng.choice(list(blanks + "   ab1.'"), 30)) for _ in range(2000)]
    assert [bpe.ids(t).tolist() for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_uses_everything_once():
    rng = np.random.RandomState(0)
    for _ in range(20):
        h = {int(b): int(rng.randint(1, 500)) for b in rng.choice(np.arange(1, 65), rng.randint(1, 40), replace=False)}
        used: dict[int, int] = {}
        for pattern, times in packing.pack_plan(h, 64):
            assert times > 0 and sum(b * m for b, m in pattern.items()) <= 64
            for b, m in pattern.items():
                used[b] = used.get(b, 0) + m * times
        assert used == h


def test_nnls():
    x = packing.nnls(np.array([[0, -1], [1, -1], [0, 1]]), np.array([3.0, -1.0]), 2000)
    assert np.allclose(x, [3, 0, 0], atol=1e-3)


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    single = corpus_pipeline.drop_near_copies(spark, good, SF)
    assert single.columns == docs.columns and single.count() < good.count()
    clean = corpus_pipeline.cut_repeats(spark, single, SF)
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert clean.where("n_chars <> length(text)").count() == 0
    rows = corpus_pipeline.pack_sequences(spark, clean, SF).collect()
    check_packing(rows, 2048)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in clean.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeats", "packing"]


CLASHES = ("score", "kept", "spans", "n_bytes", "label", "row", "h", "size", "block", "payload", "component_id", "doc", "t", "__text", "bin", "part", "rank", "ids")


def test_pipeline_stages_bear_any_columns_and_rows(spark):
    rows = [(1, "good words here " * 30), (1, "good words here " * 30), (1, "another text of one id " * 20), (2, None), (3, ""), (None, "no id at all"), (4, "x" * 300_000), (5, "good words here " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(i))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            assert out.where(" or ".join(f"{c} <> {i}" for i, c in enumerate(CLASHES))).count() == 0
            assert out.count() <= len(rows)
        assert stage is corpus_pipeline.cut_repeats and corpus_pipeline.pack_sequences(spark, frame, SF).count() >= frame.count()
    single = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in single.collect()) == sorted([(1, 480), (1, 460), (2, 0), (3, 0), (-1, 12), (4, 300_000)])


def test_pipeline_keeps_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (1, "A b c d e f g"), (3, "a b c d e f g")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == [-1, -1, 1]
