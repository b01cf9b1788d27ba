"""The ten operators against brute force, exact round trips and held-out rows, with edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import math
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import jpeg, media, minhash, mixing, packing, search, warc
from wayfold.llm.byte_tools import slices
from wayfold.llm.context_tree import score_documents
from wayfold.llm.html_text import LABELLED_PAGES, blocks, classifier, extract, features, labelled_page, main_texts, train
from wayfold.llm.language_id import language_predictions
from wayfold.llm.scratch import stored
from wayfold.llm.url_filter import filter_urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs_of(spark, texts, langs=None, sources=None, extra=True):
    rows = [(i, t, (langs or [None] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    # Columns of the names that operators use inside or add.
    return df.withColumns({c: F.lit("x") for c in ("id", "size", "taken", "times", "score", "kept", "n", "media", "uid", "length", "lang_pred", "target")}) if extra else df


def random_text(rng, n):
    return " ".join(rng.choice(WORDS, n))


# --- 1: media


@pytest.mark.parametrize("text", ["", "a", "x" * 64, "x" * 65, "\0" * 200, "é日本\n" * 99, "the quick brown fox " * 30_000, bytes(range(128)).decode() * 9])
def test_jpeg_round_trip(text):
    files = [f for _, _, buf, off in slices(pa.array([text, None])) for f in media.text_image(buf, off)]
    found = media._features(files[0], media._decoded(files)[0])
    data = text.encode()
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    assert found[4:] == (len(files[0]), hashlib.sha256(files[0]).hexdigest(), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_jpeg_of_many_components_and_no_restarts():
    """A colour file (4:2:0) written here bit by bit, without restart markers."""
    rng = np.random.default_rng(3)
    mcus, pattern = (2, 3), [0, 0, 0, 0, 1, 2]
    want = rng.integers(-40, 40, (6 * 6, 64)) * (rng.random((36, 64)) < 0.2)
    (dc, dc_n), (ac, ac_n) = jpeg.DC_TABLE.codes(), jpeg.AC_TABLE.codes()
    bits, pred = "", [0, 0, 0]

    def value(v):
        size = abs(int(v)).bit_length()
        return size, format(int(v) if v > 0 else int(v) + (1 << size) - 1, f"0{size}b") if size else ""

    for i, block in enumerate(want):
        c = pattern[i % 6]
        size, low = value(block[0] - pred[c])
        pred[c] = block[0]
        bits += format(int(dc[size]), f"0{dc_n[size]}b") + low
        run = 0
        for k in range(1, 64):
            if not block[k:].any():
                bits += format(int(ac[0]), f"0{ac_n[0]}b")
                break
            if block[k] == 0:
                run += 1
                continue
            while run > 15:
                bits += format(int(ac[0xF0]), f"0{ac_n[0xF0]}b")
                run -= 16
            size, low = value(block[k])
            bits += format(int(ac[run << 4 | size]), f"0{ac_n[run << 4 | size]}b") + low
            run = 0
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = jpeg._segment
    steps = bytes([16] + [1] * 63)
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + steps) + seg(0xC0, bytes([8, 0, 30, 0, 45, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + jpeg._TABLES + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + jpeg.END
    image = jpeg.parse(data)
    assert (image.width, image.height, image.mcus) == (45, 30, mcus)
    got = jpeg.decode_scans([image], [data])[0]
    assert (got == want).all()
    thumb = jpeg.luminance(image, got)
    assert thumb.shape == (4, 6) and thumb[0, 1] == np.clip((want[1, 0] * 16 + 4) // 8 + 128, 0, 255) and thumb[1, 0] == np.clip((want[2, 0] * 16 + 4) // 8 + 128, 0, 255)


def test_zigzag_is_the_known_order():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


def test_media_table(spark):
    texts = ["same", "same", None, "", "other " * 5000]
    made = media.text_media(docs_of(spark, texts))
    rows = {r.id: r for r in media.read_media(stored(made)).collect()}
    assert len(rows) == 5 and rows[0].media_sha256 == rows[1].media_sha256 and rows[2].n_bytes == rows[3].n_bytes == 0 and rows[2].payload_bytes == 64
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xff\xd8nothing"))], "id long, media binary")
    assert [r.width for r in media.read_media(broken).collect()] == [None] * 3
    assert media.read_media(made.limit(0)).count() == 0


def test_damaged_files_give_nulls(spark):
    """Short headers, lost restart markers, cut scans, missing tables and frames far larger than the file."""
    text = "the quick brown fox jumps over the lazy dog " * 3000
    whole = media.text_image(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    frame, table, quant, scan = (whole.index(bytes([255, m])) for m in (0xC0, 0xC4, 0xDB, 0xDA))
    mark = whole.index(b"\xff\xd0", scan)
    bad = [
        whole[:frame] + b"\xff\xc0\x00\x05\x08\x00\x08" + whole[scan:], whole[:mark] + whole[mark + 2 :], whole[: scan + 20], whole[: len(whole) // 2],
        whole[:table] + whole[scan:], whole[:quant] + whole[frame:], whole[: frame + 5] + b"\xff\xff\xff\xff" + whole[frame + 9 :], whole[:30], b"\xff\xd8\xff", b"\xff\xd8\xff\xdb\x00\x03\x00",
    ]
    rows = [(0, whole), *enumerate(bad, 1), (99, whole)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, media binary").coalesce(1)
    got = {r.id: r for r in media.read_media(df).collect()}
    assert got[0].n_bytes == got[99].n_bytes == len(text) and got[0].payload_sha256 == got[99].payload_sha256
    assert [i for i in range(1, 1 + len(bad)) if got[i].n_bytes is not None and got[i].payload_sha256 == got[0].payload_sha256] == []
    assert [got[i].width for i in range(1, 1 + len(bad))] == [None] * len(bad)


# --- 2: mixing


def test_flow_prefers_new_words_to_repeats():
    flow = mixing.route([(("a",), 100), (("a", "b"), 100), (("b",), 10)], {"a": 150, "b": 60}, 2)
    assert sum(n for (_, s), n in flow.items() if s == "a") == 150 and sum(n for (_, s), n in flow.items() if s == "b") == 60
    taken = [sum(n for (p, _), n in flow.items() if p == k) for k in range(3)]
    assert taken == [100, 100, 10]


def cost_of(taken, supplies):
    """The price of ``taken`` words of each pattern: 1 for first copies, 3 for second ones."""
    return sum(min(t, n) + 3 * max(0, t - n) for t, (_, n) in zip(taken, supplies, strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_of_least_cost(seed):
    """Against all whole flows of small instances: as much flows as can, at the least price."""
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c"][: 2 + seed % 2]
    patterns = [p for k in (1, 2, 3) for p in itertools.combinations(names, k)]
    supplies = [(patterns[i], int(rng.integers(0, 4))) for i in rng.choice(len(patterns), 3, replace=False)]
    quotas = {s: int(rng.integers(0, 6)) for s in names}
    flow = mixing.route(supplies, quotas, 2)
    assert all(sum(n for (_, s), n in flow.items() if s == name) <= quotas[name] for name in names)
    mine = [sum(n for (p, _), n in flow.items() if p == k) for k in range(3)]
    assert all(t <= 2 * n for t, (_, n) in zip(mine, supplies, strict=True)) and all(s in supplies[p][0] for p, s in flow)

    def splits(total, parts):
        return [()] if not parts else [(x, *rest) for x in range(total + 1) for rest in splits(total - x, parts - 1)]

    best = max((sum(map(sum, choice)), -cost_of([sum(c) for c in choice], supplies)) for choice in itertools.product(*(splits(2 * n, len(p)) for p, n in supplies)) if all(sum(x for c, (p, _) in zip(choice, supplies, strict=True) for x, s in zip(c, p, strict=True) if s == name) <= quotas[name] for name in names))
    assert (sum(mine), -cost_of(mine, supplies)) == best


def test_flow_over_many_patterns():
    rng = np.random.default_rng(0)
    names = [f"s{k}" for k in range(60)]
    supplies = [(tuple(sorted(rng.choice(names, 3, replace=False))), int(rng.integers(1, 1000))) for _ in range(5000)]
    total = sum(n for _, n in supplies)
    flow = mixing.route(supplies, {s: total // 50 for s in names}, 2)
    assert sum(flow.values()) == 60 * (total // 50) or sum(flow.values()) == 2 * total


def test_targets_stop_at_twice_the_size(spark):
    def targets(sizes, weights):
        frame = spark.createDataFrame([(f"{k:03}", n) for k, n in enumerate(sizes)], "name string, size long")
        return [r.target for r in mixing.capped_targets(frame, weights, 1.5, 2).orderBy("name").collect()]

    sizes = [10, 1000, 500, 700]
    found = targets(sizes, (3, 1, 2))
    assert found == pytest.approx([20, 895, 1000, 1400])
    assert targets([], (1,)) == [] and targets([0, 0], (1, 2)) == [0, 0]
    powers = [2**k for k in range(30)]
    assert sum(targets(powers, (3, 1, 2))) == pytest.approx(1.5 * sum(powers))


def test_a_source_for_each_document(spark):
    """Sources that do not overlap are components of their own, however many there are."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id").cast("string")).alias("source"), (F.col("id") % 7).alias("n"))
    out = mixing.mix(docs, F.col("n")).toPandas()
    assert len(out) == 3000 and (out.target <= 2 * out["size"] + 1e-9).all() and out.target.sum() == pytest.approx(1.5 * out["size"].sum()) and (abs(out.taken - out.target) <= out["size"]).all()


def test_components_route_as_the_whole_graph(spark, monkeypatch):
    rng = np.random.default_rng(3)
    links, supplies, quotas = [], [], {}
    for part in range(6):
        names = [f"{part}{c}" for c in "abcd"]
        quotas |= {n: int(rng.integers(1, 4000)) for n in names}
        for k in range(9):
            own = tuple(sorted(rng.choice(names, rng.integers(1, 4), replace=False)))
            supplies.append((own, int(rng.integers(0, 900))))
            links += [(f"p{part}{k}", n, supplies[-1][1], float(quotas[n])) for n in own]
    frame = spark.createDataFrame(links, "pattern string, name string, words long, target double")
    mine = mixing.routed(frame, 2).toPandas()
    total = lambda flows: sum(flows.values())
    whole = mixing.route(supplies, quotas, 2)
    price = lambda of: cost_of(of, supplies)
    order = [f"p{part}{k}" for part in range(6) for k in range(9)]
    by_pattern = mine.groupby("pattern").flow.sum()
    assert mine.flow.sum() == total(whole) and price([int(by_pattern.get(p, 0)) for p in order]) == price([sum(n for (p, _), n in whole.items() if p == k) for k in range(len(order))])
    assert all(flow <= quotas[name] for name, flow in mine.groupby("name").flow.sum().items())
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 8)
    with pytest.raises(Exception, match="coarser"):
        mixing._routed(frame.withColumn("repeats", F.lit(2)).toPandas())


def test_the_query_routes_all_its_words(spark, monkeypatch):
    """What op2_mixing_flow takes comes from the flow: its targets are met by it to a word, at the least price."""
    seen, routed = [], mixing.routed
    monkeypatch.setattr(mixing, "routed", lambda links, repeats: seen.append((links, routed(links, repeats))) or seen[-1][1])
    out = mixing.op2_mixing_flow(spark, "/root/testdata/sf0.01").toPandas()
    links, flows = (df.toPandas() for df in seen[0])
    met = links.merge(flows, on=["pattern", "name"])
    assert len(seen) == 1 and len(met) == len(links) > 10 and (met.flow == met.target.round()).all() and (met.flow <= 2 * met.words).all()
    # The least price of a source's words, over all ways to divide them into first and second copies.
    least = [min(x + 3 * (f - x) for x in range(max(0, f - w), min(f, w) + 1)) for f, w in zip(met.flow.tolist(), met.words.tolist(), strict=True)]
    assert least == [cost_of([f], [(None, w)]) for f, w in zip(met.flow, met.words, strict=True)]
    assert abs(out.taken.sum() - met.flow.sum()) <= 0.01 * met.flow.sum()


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(5)
    texts = [random_text(rng, int(n)) for n in rng.pareto(1.2, 900) * 20 + 1] + [None, "", " \n"]
    sources = [str(s) for s in rng.choice(["a", "b", "c", "d"], 900, p=[0.7, 0.1, 0.1, 0.1])] + ["a", None, "b"]
    docs = docs_of(spark, texts, sources=[*sources[:50], *[None] * 10, *sources[60:]])
    first, again = (mixing.mix(docs.repartition(n), mixing.word_count("text")).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (1, 3))
    assert first.equals(again) and len(first) == len(texts)
    assert (first["size"] == [len((t or "").split()) for t in texts]).all() and (first.taken <= 2 * first["size"]).all() and (first.taken % first["size"].clip(1) == 0).all()
    sums = first.groupby(first.source.fillna("~"), as_index=True).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(sums.taken - sums.target) <= 0.02 * sums.target + 5).all(), sums
    assert sums.target.sum() == pytest.approx(1.5 * first["size"].sum())


def test_mix_of_overlapping_sources_and_nothing(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else [], 10) for i in range(300)], "doc_id long, source array<string>, n long")
    out = mixing.mix(df, F.col("n")).toPandas()
    assert (out[out.source.map(len) == 0].taken == 0).all() and out[out.source.map(len) == 2].taken.sum() + out[out.source.map(len) == 1].taken.sum() > 0
    assert mixing.mix(df.limit(0), F.col("n")).count() == 0


# --- 3: WARC


def test_warc_round_trip_and_revisits(spark):
    same = "<p>same\r\n\r\nWARC/1.1\r\n</p>" + "é" * 10
    rows = [(5, "http://a\r\nX: y", same), (9, None, same), (7, "http://b", same), (1, "u", None), (2, "u", ""), (3, "u", "only"), (None, "u", same), (4, "u", "twice"), (4, "u", "twice"), (8, "u", "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("bytes", "digest", "type", "path", "record_id")})
    records, path = warc.deduplicated(pages.repartition(3))
    out = [(r.page_id, r.bytes, r.digest, r.type, r.refers_to) for r in records.collect()]
    want = lambda t: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode())
    expected = [(5, *want(same), "revisit", 9), (9, *want(same), "response", None), (7, *want(same), "revisit", 9), (None, *want(same), "revisit", 9), (1, *want(""), "revisit", 2), (2, *want(""), "response", None), (3, *want("only"), "response", None), (4, *want("twice"), "response", None), (4, *want("twice"), "revisit", 4), (8, *want("long " * 200_000), "response", None)]
    assert sorted(map(repr, out)) == sorted(map(repr, expected))
    again = warc.resolve(warc.read_records(spark, path))
    assert sorted((repr(r.page_id), r.type) for r in again.collect()) == sorted((repr(e[0]), e[3]) for e in expected)
    small, _ = warc.deduplicated(pages, min_payload=10)
    assert {r.type for r in small.where("bytes < 10").collect()} == {"response"}
    assert warc.deduplicated(pages.limit(0))[0].count() == 0


def members(data):
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data)
        data = one.unused_data


def test_references_resolve_in_the_new_archives(spark, tmp_path, monkeypatch):
    """Each record is a gzip member of its own, files are cut by bytes, and each revisit names a response that is there."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rng = np.random.default_rng(2)
    rows = [(i, f"http://site/{i}", ["same text", "other \xe9"][i % 2] if i % 3 else random_text(rng, 200)) for i in range(60)]
    _, path = warc.deduplicated(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2))
    files = [f.read_bytes() for f in Path(path.removeprefix("file:")).glob("part-*")]
    assert len(files) > 4 and all(len(f) < 6000 for f in files)
    heads = {}
    for file in files:
        *records, last = members(file)
        assert last == b""
        for record in records:
            (head, block), = warc.parsed(gzip.compress(record))
            heads[head["warc-record-id"]] = head, block
    assert len(heads) == 60
    revisits = [h for h, _ in heads.values() if h["warc-type"] == "revisit"]
    assert len(revisits) == 38
    for head in revisits:
        target, block = heads[head["warc-refers-to"]]
        assert target["warc-type"] == "response" and target["page-id"] == head["refers-to-page"] and target["warc-payload-digest"] == head["warc-payload-digest"]
        assert head["warc-refers-to-target-uri"] == target["warc-target-uri"] and head["warc-refers-to-date"] == target["warc-date"] and int(head["payload-length"]) == len(block.partition(warc.END)[2])


# --- 4: HTML


PAGE = "<html><head><title>T</title><style>p{}</style><script>var x='</p>'</script></head><body><nav><ul><li><a href='a>b'>Home</a></li></ul></nav><!-- c <p>x</p> --><div class='ad'>Buy</div><article><h1>Head &amp; <em>line</em></h1><p><b>One\n two&nbsp;<br>three<p>Vier &lt;b&gt; fünf.</p><div class='comments'><p>No!</p></div><p>As.</p></article><footer>&copy; us</footer></body></html>"


def test_main_text():
    assert main_texts([PAGE, None, "", "<script>x", "<p", "<!-- "], classifier()) == ["Head & line\nOne two three\nVier <b> fünf.\nAs.", "", "", "", "", ""]
    assert [b.text for b in blocks("a<div>b<span>c</span> d<p>e</div>f")] == ["a", "bc d", "e", "f"]
    long = "<article>" + "<p><b>word word" * 5000 + "</article>"
    assert main_texts([long], classifier())[0] == "\n".join(["word word"] * 5000)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = extract(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(None, 0), (1, 44), (1, 44)] and rows[1].text.endswith("As.")
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a href="', "<b></i>", "<i><div><b></i>", "<script></script ", "<", "<!--", "</p", '<p a="', "<p>", "&", "&#", "<a ="])
def test_a_megabyte_of_anything_is_read(piece):
    start = time.perf_counter()
    main_texts([piece * (1_000_000 // len(piece))], classifier())
    assert time.perf_counter() - start < 20


def test_odd_markup():
    read = lambda page: [b.text for b in blocks(page)]
    assert read("<p title='a>b\">one<p>two") == ['b">one', "two"]
    assert read('<p a="x>y">one</p>3 < 4 <3 <p/>two</P ><!-->three<!---->four<!bogus>five') == ["one", "3 < 4 <3", "two", "threefourfive"]
    assert read("a&#65;&#x42;&#00000000067;&#9999999999999;&#x110000;&#" + "9" * 9000 + ";b") == ["aABC\ufffd\ufffd\ufffdb"]
    assert read("<SCRIPT>x</scripty></ScRiPt >a<style/>b") == ["ab"]


UNNAMED = (  # no articles, names or sections
    "<div><a>Start</a></div><div><a>Garden</a> <a>House</a></div><div>Since 1950</div>"
    "<div>{0}</div><div>Nobody saw it.</div><div>{0} {0}</div><div>They left.</div><div>{0}</div>"
    "<div>Write to us</div><div><a>Older</a></div><div>All rights ours</div>"
)


def test_neighbours_decide_in_pages_of_plain_blocks():
    text = "When the ferry came back in the evening most of the people on the pier had already gone home, and only a dog was waiting there."
    made = blocks(UNNAMED.format(text))
    assert not any(b.article or b.other for b in made)
    want = [b.text.startswith("When") or b.text in ("Nobody saw it.", "They left.") for b in made]
    x = features(made)
    assert classifier().decide(x).tolist() == want
    x[:, [0, 2, 3, 5]] = 0
    assert classifier().decide(x).tolist() != want


def test_figures_decide_on_the_given_pages():
    """Elements only settle what the six figures leave open; texts are the pages' articles to a block."""
    made = [blocks(p) for p in pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html]
    x, tree = np.concatenate([features(p) for p in made]), classifier()
    found = tree.decide(x)
    assert found.tolist() == [b.article and not b.other for p in made for b in p]

    def changed(columns):
        y = x.copy()
        y[:, columns] = 0
        return (tree.decide(y) != found).mean()

    def open_to(node, rows):
        """Rows that reach a split by kinds of elements."""
        if node.low is None or not len(rows):
            return 0
        if node.by >= 6:
            return len(rows)
        below = rows[:, node.by] <= node.at
        return open_to(node.low, rows[below]) + open_to(node.high, rows[~below])

    assert changed([0, 1, 2, 3, 4, 5]) > 0.5 and changed([0, 2, 3, 5]) > 0.15 and changed([6, 7, 8, 9]) < 0.03 and open_to(tree, x) < 0.7 * len(x)


def test_the_labelled_table_is_learned():
    """Each labelled page left out in turn: the others tell nearly all its blocks."""
    pages = [blocks(labelled_page(line)) for line in LABELLED_PAGES]
    right = total = 0
    for k, page in enumerate(pages):
        rest = [p for i, p in enumerate(pages) if i != k]
        tree = train(np.concatenate([features(p) for p in rest]), np.array([b.keep for p in rest for b in p], float))
        right += (tree.decide(features(page)) == [b.keep for b in page]).sum()
        total += len(page)
    assert right > 0.93 * total


# --- 5: context-tree weighting


def test_scores_are_probabilities_and_match_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [random_text(rng, int(n)) for n in rng.integers(1, 60, 120)] + ["", None, "ALPHA", "unseen words here", "alpha " * 20_000]
    docs = docs_of(spark, texts)
    out = score_documents(docs, F.col("doc_id") % 7 == 2).toPandas().sort_values("doc_id").reset_index(drop=True)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split() + [None]
    counts: dict = {}
    for i, t in enumerate(texts):
        if i % 7 != 2:
            for w in lower(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    base = [sum(np.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in lower(t)) for t in texts]
    assert np.allclose(out.base_score, base) and (out.train_tokens == total).all()
    assert (out.n_tokens == [len(lower(t)) for t in texts]).all() and (out.n_known == [sum(w in counts for w in lower(t)) for t in texts]).all()
    assert (out.score < 0).all() and out.bits_per_byte.iloc[-1] < 1 < out.bits_per_byte[out.doc_id == len(texts) - 2].iloc[0] * 10
    held = out[out.held_out & (out.n_tokens > 20)]
    assert held.bits_per_byte.mean() < 3


def brute_force_tree(train, depth):
    """text -> log10 probability, straight from the definition: the ratio of weighted probabilities with and without one more bit."""
    counts = {}  # (binary node, context) -> [zeros, ones]

    def walk(text):
        data = bytes(depth) + text.encode() + b"\0"
        for i in range(depth, len(data)):
            for k in range(8):
                yield (k, data[i] >> (8 - k)), data[i - depth : i], (data[i] >> (7 - k)) & 1

    for text in train:
        for node, before, bit in walk(text):
            for d in range(depth + 1):
                counts.setdefault((node, before[depth - d :]), [0, 0])[bit] += 1
    longer = {}
    for node, ctx in counts:
        if ctx:
            longer.setdefault((node, ctx[1:]), set()).add(ctx)

    def estimate(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - 2 * math.lgamma(0.5)

    def weighted(node, ctx, extra):
        """ln of the weighted probability of a context's bits; ``extra`` is (context of the new bit, bit) or None."""
        zeros, ones = counts.get((node, ctx), (0, 0))
        if extra and extra[0].endswith(ctx):
            zeros, ones = zeros + (extra[1] == 0), ones + (extra[1] == 1)
        own = estimate(zeros, ones)
        if len(ctx) == depth:
            return own
        children = set(longer.get((node, ctx), ()))
        if extra and extra[0].endswith(ctx):
            children.add(extra[0][depth - len(ctx) - 1 :])
        split = sum(weighted(node, c, extra) for c in children)
        high = max(own, split)
        return math.log(0.5) + high + math.log(math.exp(own - high) + math.exp(split - high))

    plain = {}

    def log10_probability(text):
        total = 0.0
        for node, before, bit in walk(text):
            if node not in plain:
                plain[node] = weighted(node, b"", None)
            total += weighted(node, b"", (before, bit)) - plain[node]
        return total / math.log(10)

    return log10_probability


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_scores_equal_brute_force_context_trees(spark, depth):
    rng = np.random.default_rng(depth)
    texts = ["".join(rng.choice(list("abca é"), int(n))) for n in rng.integers(0, 40, 12)] + ["abcabcabc", "ab", "zz", "", None]
    held = [i % 4 == 1 for i in range(len(texts))]
    score = brute_force_tree([t or "" for t, h in zip(texts, held, strict=True) if not h], depth)
    out = score_documents(docs_of(spark, texts), F.col("doc_id") % 4 == 1, depth=depth).orderBy("doc_id").collect()
    assert [r.held_out for r in out] == held
    assert np.allclose([r.score for r in out], [score(t or "") for t in texts], rtol=1e-6)


def test_scoring_without_training_rows(spark):
    out = score_documents(docs_of(spark, ["a b", ""]), F.lit(True)).toPandas()
    assert np.allclose(out.base_score, 0) and np.allclose(out.bits_per_byte, 8) and (out.n_known == 0).all()
    assert score_documents(docs_of(spark, ["a"]).limit(0), F.lit(False)).count() == 0


@pytest.mark.parametrize(("head", "piece"), [(64, 500)])
def test_every_context_takes_part(spark, monkeypatch, head, piece):
    """More byte strings than the broadcast head holds, in many pieces: scores equal those of one piece and one table."""
    from wayfold.llm import context_tree as tree

    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz é"), 700)) for _ in range(20)] + ["", None, "a" * 3000]
    docs = docs_of(spark, texts)
    whole = score_documents(docs, F.col("doc_id") % 4 == 1).orderBy("doc_id").collect()
    monkeypatch.setattr(tree, "HEAD_GRAMS", head)
    monkeypatch.setattr(tree, "SUBTREES", piece)
    parts = score_documents(docs, F.col("doc_id") % 4 == 1).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in whole], [r.score for r in parts], rtol=1e-9)


def test_held_out_documents_are_told_better_than_by_words(spark):
    """On the given documents: held-out texts are more probable by the tree than by the base over words, in sum and for most."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).toPandas()
    held = out[out.held_out]
    assert len(held) > 1000 and held.score.sum() > 0.97 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.8
    assert out[~out.held_out].bits_per_byte.mean() < held.bits_per_byte.mean() < 2.2


# --- 6: near duplicates


def brute_components(texts, n, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "percent", "pairs"), [(3, 85, 16), (5, 80, 16), (3, 85, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, n, percent, pairs):
    monkeypatch.setattr(minhash, "PAIRS", pairs)
    rng = np.random.default_rng(n)
    originals = [random_text(rng, int(k)) for k in rng.integers(20, 200, 25)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "one two"]
    for t in originals:
        texts.append(t)
        for _ in range(int(rng.integers(0, 6))):
            w = t.split()
            for k in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 25))):
                w[k] = f"edit{rng.integers(0, 999)}"
            texts.append(" ".join(w))
    w = random_text(rng, 300).split()
    for k in range(40):  # a chain whose ends are far apart
        w[7 * k] = f"step{k}"
        texts.append(" ".join(w))
    texts.append("long " * 30_000)
    out = minhash.near_duplicates(docs_of(spark, texts), shingle=n, percent=percent).toPandas().sort_values("doc_id")
    sizes, comps = brute_components(texts, n, percent)
    assert out.n_shingles.tolist() == sizes and out.component_id.tolist() == comps and out.kept.tolist() == [i == c for i, c in enumerate(comps)]


def test_pages_of_one_template(spark):
    """Texts that share most words, but mostly not enough to link: keys hold many components."""
    rng = np.random.default_rng(12)
    frame = random_text(rng, 120).split()
    texts = []
    for k in range(60):
        own = [f"own{k}x{i}" for i in range(12)]
        texts.append(" ".join(frame[:60] + own + frame[60:]))
        if k % 6 == 0:
            texts.append(" ".join(frame[:60] + own[:-1] + frame[60:]))
    out = minhash.near_duplicates(docs_of(spark, texts), shingle=3, percent=85).toPandas().sort_values("doc_id")
    assert out.component_id.tolist() == brute_components(texts, 3, 85)[1]


def test_recall_on_documents(spark):
    """Of the links that all pairs of the given documents have, at least 0.9 are inside one component."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").toPandas()
    out = minhash.near_duplicates(docs, shingle=3, percent=85).toPandas().set_index("doc_id")
    _, comps = brute_components(rows.text.tolist(), 3, 85)
    want = [rows.doc_id.iloc[c] for c in comps]
    linked = [(i, w) for i, w in zip(rows.doc_id, want, strict=True) if i != w]
    found = [out.component_id[i] == out.component_id[w] for i, w in linked]
    assert len(linked) > 5 and np.mean(found) >= 0.9
    assert not [i for i, w in zip(rows.doc_id, want, strict=True) if i == w and out.component_id[i] != i and i not in want]


def test_components_of_a_long_randomly_numbered_path(spark):
    from wayfold.llm.components import components

    ids = np.random.default_rng(3).permutation(1000).tolist()
    rows = [(min(x), max(x)) for x in zip(ids, ids[1:], strict=False)] + [(2000, 2001)]
    out = components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert sorted((r.id, r.comp) for r in out) == [(i, 0) for i in range(1000)] + [(2000, 2000), (2001, 2000)]


def test_sketches_lose_no_link():
    rng = np.random.default_rng(1)
    for n in (30, 300, 3000):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * 0.93)], rng.integers(0, 1 << 62, n - int(n * 0.93)).astype(np.uint64)])
        x, y = minhash.parities([np.unique(a), np.unique(b)])
        apart = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "x y z x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(docs).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id), r.kept) for r in out) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]
    assert sorted(repr(r.doc_id) for r in minhash.without_near_duplicates(docs).collect()) == ["1", "3", "None"]
    assert minhash.without_near_duplicates(docs.limit(0)).count() == 0


# --- 7: language ID


def test_languages_on_held_out_rows(spark):
    words = {"en": "the of and that with for was are this which", "de": "der die und das nicht mit ein auf für ist", "fr": "le la les des que pour dans une est être"}
    rng = np.random.default_rng(4)
    langs = [str(rng.choice(list(words))) for _ in range(400)]
    texts = [" ".join(rng.choice(words[x].split(), int(rng.integers(5, 60)))) for x in langs]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(900, None, None), (901, "12 !", "en"), (902, "", None), (903, "der und " * 200_000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = language_predictions(rows).toPandas().set_index("doc_id")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out.lang_pred[i] == langs[i] for i in held]) > 0.99
    assert out.lang_pred[[900, 901, 902]].tolist() == ["und"] * 3 and out.score[900] == 0 and out.lang_pred[903] == "de" and out.score.between(0, 1).all()
    assert language_predictions(rows.where("lang is null")).where("lang_pred <> 'und'").count() == 0
    assert language_predictions(rows.limit(0)).count() == 0


def test_languages_of_the_given_documents(spark):
    """Accuracy on rows that are held out, of the labelled ones: at least 0.95; documents of other scripts and none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_predictions(docs, keep=("lang",)).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).where("lang is not null").toPandas()
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() >= 0.95, (out.lang == out.lang_pred).mean()


def test_filter_slots_know_all_languages_of_a_gram(spark):
    """No n-gram that occurs often in one language alone is lost, and the mask of a shared one names both."""
    from wayfold.llm import language_id

    rows = spark.createDataFrame([(i, "gemeinsam wort " * 5, ["de", "nl"][i % 2]) for i in range(20)] + [(99, "eigen wort " * 50, "nl")], "id long, text string, lang string")
    langs, masks = language_id.fit(rows)
    grams, _ = language_id.text_grams(np.frombuffer(b"gemeinsam", np.uint8), np.array([0, 9]))
    hit = np.bitwise_and.reduce([masks[0][s] for s in language_id.slots_of(grams, masks.shape[1])])
    assert langs == ["de", "nl"] and (hit & 1).all() and len(hit) > 3


# --- 8: search


def brute_top(ids, vectors, queries, k):
    out = []
    for q in queries:
        v = vectors[ids.index(q)]
        scored = sorted((-int(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in zip(ids, vectors, strict=True) if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


SMALL = {"GROUP": 4, "BLOCK": 40, "SAMPLE": 20, "FANOUT": 6, "LEAF": 10, "LANE": 8, "DEAL": 50}


def clustered(rng, centres, each, dim, spread):
    return np.concatenate([rng.normal(size=(each, dim)) * spread + c for c in rng.normal(size=(centres, dim)) * 3])


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    for name, value in SMALL.items() if small else ():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(8)
    x = np.concatenate([clustered(rng, 4, 150, 6, 0.1), np.tile([1.0, 2, 3, 4, 5, 6], (200, 1))])
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    bad = [(9000, None), (9020, [1.0, None]), (9040, [float("nan")]), (9060, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("score", "v", "path", "ids", "asked")})
    out = sorted(map(tuple, search.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()))
    ints = np.floor(64 * x.astype(np.float32).astype(float)).astype(int).tolist()
    assert out == brute_top(list(range(len(x))), ints, range(0, len(x), 20), 7)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, search.top_k(few, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 8192)]
    assert search.top_k(few.limit(0), F.lit(True)).count() == 0 and search.top_k(few, F.lit(False)).count() == 0


@pytest.mark.parametrize("large", [2.0**15, 2.0**20, 2.0**27, 2.0**40])
def test_search_with_large_components(spark, large):
    """Sums beyond 2**53, then beyond 64 bits, stay in order; ties still go to the smaller id."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(60, 40)) * large)
    x[30:33] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = sorted(map(tuple, search.top_k(df, F.col("vec_id") % 7 == 0, 9).collect()))
    ints = [[int(c) * 64 for c in v] for v in x]
    if large < 2.0**25:
        assert out == brute_top(list(range(60)), ints, range(0, 60, 7), 9)
    else:
        assert len(out) == 9 * 9 and {r[3] for r in out if r[1] == 1} == {(1 << 63) - 1}


def pruned_share(spark, x, k=5):
    """The share of (query, row) products that node pairs of both trees rule out before any task multiplies."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, q array<double>").select("id", F.transform("q", lambda c: F.floor(64 * c)).alias("q"), (F.col("id") % 5 == 0).alias("asked"))
    made = search.stored(search.packed(search.grown(search.stored(search.classes(search.coded(df, x.shape[1], "<i4"), k)), x.shape[1], "<i4"), x.shape[1], "<i4", k))
    groups, data = made.where("not is_block"), made.where("is_block")
    left = search.needed(made).join(groups.select(F.col("path").alias("q_path"), F.col("part").alias("q_part"), F.col("n").alias("q")), ["q_path", "q_part"]).join(data.select("path", "n"), "path")
    assert left.groupBy("q_path", "q_part", "path").count().where("count > 1").isEmpty()
    depth = made.agg(F.max(F.size("path"))).first()[0]
    return depth, 1 - left.agg(F.sum(F.col("q") * F.col("n"))).first()[0] / (groups.agg(F.sum("n")).first()[0] * data.agg(F.sum("n")).first()[0])


def test_dual_tree_prunes_clustered_vectors(spark, monkeypatch):
    for name, value in SMALL.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(1)
    depth, share = pruned_share(spark, clustered(rng, 12, 100, 8, 0.05))
    assert depth >= 2 and share > 0.8, (depth, share)


@pytest.mark.parametrize("shape", ["clusters", "line", "noise", "copies", "one"])
def test_cover_tree_invariants(shape):
    """Covering, nesting and separation of every level; nodes are ranges that begin with their centres."""
    rng = np.random.default_rng(0)
    x = {"clusters": clustered(rng, 9, 100, 5, 0.05), "line": np.arange(700.0)[:, None] ** 2, "noise": rng.normal(size=(600, 20)), "copies": np.ones((300, 3)), "one": np.ones((1, 3))}[shape]
    order, sizes = search.cover_tree(x, 10)
    assert sorted(order.tolist()) == list(range(len(x))) and all(n.sum() == len(x) for n in sizes)
    y, apart = x[order], lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    radius = float(apart(y[:1], y).max())
    begins = [np.cumsum(n) - n for n in sizes]
    for coarse, fine in zip(begins[:-1], begins[1:], strict=True):
        assert set(coarse) <= set(fine)  # nesting: a centre is the first row of its own child
    for b in begins[1:]:
        own = apart(y[b], y[b]) + np.eye(len(b)) * 1e9
        cover = apart(y, y[b]).min(1).max()
        assert own.min() > cover * 0.999 and cover < radius  # separation beyond the radius within which every row is covered
        radius = cover + 1e-9
    assert len(sizes) > (3 if shape in ("clusters", "line") else 0)
    assert [n.tolist() for n in search.levels_from_bytes(search.levels_to_bytes(sizes))] == [n.tolist() for n in sizes]


def test_node_pairs_lose_nothing_and_prune():
    """At the query's own parameters, on one block of clustered vectors and on the given ones."""
    def looked(x, queries):
        (qo, qs), (xo, xs) = search.cover_tree(queries, search.FEW), search.cover_tree(x)
        q, d = queries[qo], x[xo]
        product = q @ d.T
        worst = np.sort(product, 1)[:, -20]
        open_, pairs = search.node_pairs(search.Tree(q, qs), search.Tree(d, xs), worst)
        leaf = lambda n: np.repeat(np.arange(len(n)), n)
        reachable = open_[leaf(qs[-1])][:, leaf(xs[-1])]
        assert reachable[product >= worst[:, None]].all()
        return 1 - reachable.mean(), pairs

    x = np.floor(64 * clustered(np.random.default_rng(2), 40, 100, 16, 0.1))
    share, pairs = looked(x, x[::20])
    assert share > 0.9 and pairs > 100
    given = np.floor(64 * np.array(pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet").embedding.tolist(), float))
    assert looked(given, given[::20])[1] > 10


# --- 9: URL filter


def test_url_rules(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("Com", "/fr/", "allow"), ("com", "/fr/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://A.Example.org/es/x?y", "http://org/", "http://xorg/", "https://b.com/fr/1#z", "http://b.com/fr", "nothing", None, "http://example.org?q=/es/", "ftp://example.org/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0]])], "page_id int, url string").withColumns({"rule": F.lit(1), "rule_host": F.lit(2), "k": F.lit(3)})
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules, default="none").collect()}
    assert rows[0] == rows[9] == ("a.example.org", "/es/x", "example.org/es/", "block") and rows[1] == ("org", "/", "org/", "allow") and rows[2][2:] == (None, "none")
    assert rows[3] == ("b.com", "/fr/1", "com/fr/", "allow") and rows[4][3] == "none" and rows[5] == rows[6] == ("", "", None, "none") and rows[7] == ("example.org", "", None, "none") and rows[8][3] == "block"
    assert {r.verdict for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"} and filter_urls(pages.limit(0), rules).count() == 0


# --- 10: packing


def test_word_by_word_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    slow.encode_special_tokens = True
    encode = packing.encoder(str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()
    texts += [" ", " a ", "  a  b \n c\n\nd\n", "x\n", "\nx", "a\xa0b", "a\x1cb \x1c c", "don't we'll  'tis", "<|endoftext|> a", "é" * 9, "x" * 30_000, " " * 30_000 + "x", "a\r\nb c\r\n d", "日本 語\n日本"]
    assert [encode(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_packing_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 64)
    rng = np.random.default_rng(6)
    texts = [random_text(rng, int(n)) for n in rng.integers(1, 400, 150)] + [None, "", "same", "same", "token " * 9000]
    docs = docs_of(spark, texts)
    out = packing.pack(packing.token_pieces(docs.union(docs.where("doc_id = 3")), keep_ids=True), shard=64).toPandas()
    encode = packing.encoder(*map(str, map(__import__("public_tokenizers").path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))))
    for i, t in enumerate(texts):
        own = out[out["id"] == i].sort_values("piece")
        ids = np.append(np.frombuffer(encode(t) if t else b"", "<u4"), 0)
        if i != 3:
            assert np.concatenate(own["ids"].tolist()).tolist() == ids.tolist() and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(own["ids"], own.ids_crc32, strict=True))
        assert len(own) == (2 if i == 3 else -(-len(ids) // 2048)) and (own.length[own.piece > 0] == 2048).all()
    filled = out.sort_values("offset").groupby("sequence_id")
    assert all((g.offset.to_numpy() == np.concatenate(([0], np.cumsum(g.length)[:-1]))).all() and g.length.sum() <= 2048 for _, g in filled)
    assert len(filled) <= -(-out.length.sum() // 2048) * 1.05 + 4
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 300).tolist()
    a, b = packing.first_population(lengths, 2048, rng)[:2]
    for child in (packing.crossover(a, b, lengths, 2048, rng), packing.mutated(a, lengths, 2048, rng)):
        assert sorted(i for x in child for i in x) == list(range(300)) and all(sum(lengths[i] for i in x) <= 2048 for x in child)


def triplets(rng, bins, size):
    """Pieces that fill ``bins`` bins by threes, in random order."""
    a = rng.integers(int(size * 0.38), int(size * 0.49), bins)
    b = rng.integers(int(size * 0.27), int(size * 0.30), bins)
    return rng.permutation(np.concatenate([a, b, size - a - b])).tolist()


def test_evolution_beats_best_fit_decreasing():
    """Triplets: best fit in decreasing order wastes room, crossover and exchange win most of it back."""
    lengths = triplets(np.random.default_rng(3), 60, 1000)
    order = np.argsort(-np.array(lengths), kind="stable")
    plain = packing.best_fit(lengths, 1000, order)
    rng = np.random.default_rng(1)
    best = packing.evolve(packing.first_population(lengths, 1000, rng), lengths, 1000, rng, 150)[0]
    assert packing.lower_bound(lengths, 1000) == 60 and len(plain) >= 64 and len(best) <= 62
    assert sorted(i for x in best for i in x) == list(range(180)) and all(sum(lengths[i] for i in x) <= 1000 for x in best)


def test_lower_bound_holds():
    def fewest(lengths, size):
        def fits(rest, bins):
            if not rest:
                return True
            tried = set()
            for k, b in enumerate(bins):
                if b + rest[0] <= size and b not in tried:
                    tried.add(b)
                    if fits(rest[1:], [*bins[:k], b + rest[0], *bins[k + 1 :]]):
                        return True
            return False

        return next(n for n in range(len(lengths) + 1) if fits(sorted(lengths, reverse=True), [0] * n))

    rng = np.random.default_rng(5)
    cases = [rng.integers(1, 11, 7).tolist() for _ in range(60)]
    bounds = [(packing.lower_bound(c, 10), fewest(c, 10)) for c in cases]
    assert all(low <= best for low, best in bounds) and sum(low == best for low, best in bounds) > 45
    assert packing.lower_bound([], 10) == 0


def test_islands_save_sequences_and_bad_lengths_fail(spark):
    lengths = triplets(np.random.default_rng(4), 40, 100_000)
    pieces = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id long, length long, uid string").withColumn("offset", F.lit("old"))
    out = packing.pack(pieces, 100_000, generations=60).toPandas()
    plain = packing.best_fit(lengths, 100_000, np.argsort(-np.array(lengths), kind="stable"))
    assert out.sequence_id.nunique() < len(plain) and (out.groupby("sequence_id").length.sum() <= 100_000).all() and (out.uid == "x").all()
    for bad in (None, 0, 100_001):
        with pytest.raises(Exception, match="a piece has"):
            packing.pack(spark.createDataFrame([(1, bad)], "id long, length long"), 100_000).collect()
