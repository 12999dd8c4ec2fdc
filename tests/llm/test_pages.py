"""Operators on pages, vectors and archives, against brute force and on awkward rows."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pytest

from panewise.llm import html_text, neighbours, url_lists, warc

PAGES = "page_id long, url string, html string"


def test_main_text_rules():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
      <header>no</header><nav><ul><li>no<li>no</ul></nav><div class="site cookie-notice">no</div><form>no<input value="a>b"></form>
      <article class="post"><header><h1>Title&nbsp;&amp; <i>more</i></h1></header><!-- no > <p>no</p> --><p>One<br>two
        three<p>Four <span class="ad">no</span>five<div id=comments><p>no</p></div><ul><li>a<li>b &lt;c&gt;</ul>
        <table><tr><td>x<td>y<tr><td>z</table><aside>no</aside><p hidden>no</p><p style="display: none">no</p>last 1 < 2</article>
      <div class="advert">no</div><section class="comments"><p>no</p></section><footer>&copy; no</footer></body></html>"""
    assert html_text.extract(page).split("\n\n") == ["Title & more", "One two three", "Four", "five", "a", "b <c>", "x", "y", "z", "last 1 < 2"]
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("plain &eacute; text") == "plain é text"
    assert html_text.extract("<main><p>in</main><p>out") == "in"
    assert html_text.extract("<p>" * 3000 + "deep") == "deep"
    assert html_text.extract("<!-- never closed <p>x") == "" and html_text.extract("<script>never closed") == ""


@pytest.mark.parametrize("page", ["<div>x" * 200_000, "<div>x</i>" * 150_000, "<a " * 200_000, "<ul><li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<p><b>x" * 100_000 + "</p>" * 100_000, "<!-- " * 100_000, "<article><td><tr>x" * 60_000, "<a b='" * 100_000 + '"' * 3])
def test_time_does_not_grow_with_the_square_of_a_page(page):
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 8


def random_tree(rng, depth=0):
    """(name, children): children are words or trees. Names whose end tags nothing else implies."""
    kids = []
    for _ in range(rng.randint(1, 3)):
        kids.append(random_tree(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else " ".join(rng.choice(["a", "bb", "c"]) for _ in range(rng.randint(1, 3))))
    return rng.choice(["div", "section", "blockquote"]), kids


def written_tree(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(written_tree, tree[1]))}</{tree[0]}>"


def blocks_of(tree, gone):
    """Blocks of text outside the subtrees that are gone, in page order."""
    if tree in gone:
        return []
    out, text = [], ""
    for kid in tree[1]:
        if isinstance(kid, str):
            text += kid
        else:
            out += ([text] if text else []) + blocks_of(kid, gone)
            text = ""
    return out + ([text] if text else [])


def normal(tree):
    """The tree with neighbouring words as one text, so that equal subtrees are equal here too."""
    kids = []
    for kid in tree[1]:
        kid = kid if isinstance(kid, str) else normal(kid)
        if isinstance(kid, str) and kids and isinstance(kids[-1], str):
            kids[-1] += kid
        else:
            kids.append(kid)
    return tree[0], tuple(kids)


def subtrees(tree):
    return {tree}.union(*[subtrees(k) for k in tree[1] if not isinstance(k, str)])


def test_templates_equal_counting_whole_subtrees(spark):
    """Random pages without attributes against a count of the trees that they were written from."""
    rng = random.Random(21)
    shared, pages, trees = [normal(random_tree(rng)) for _ in range(5)], [], {}
    for i in range(120):
        host = f"h{i % 3}.example"
        kids = [rng.choice(shared) if rng.random() < 0.5 else random_tree(rng) for _ in range(rng.randint(1, 4))]
        trees[i] = host, normal(("div", kids))
        pages.append((i, f"http://{host}/{i}", written_tree(trees[i][1])))
    rule = html_text.Template(pages=6, share=0.2)
    found = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(pages, PAGES), rule).collect()}
    removed = 0
    for host in {h for h, _ in trees.values()}:
        mine = {i: t for i, (h, t) in trees.items() if h == host}
        different = {tuple(blocks_of(t, ())): t for t in mine.values()}
        by_text = {}
        for i, t in mine.items():
            by_text.setdefault(tuple(blocks_of(t, ())), []).append(t)
        counts = {}
        for text in different:
            for sub in subtrees(by_text[text][0]):
                counts[sub] = counts.get(sub, 0) + 1
        gone = {s for s, n in counts.items() if n >= rule.pages and n >= rule.share * len(different)}
        for i, t in mine.items():
            if len(set(by_text[tuple(blocks_of(t, ()))])) > 1:
                continue  # of different pages of one text only one counts, whichever
            left = blocks_of(t, gone) or blocks_of(t, ())
            removed += left != blocks_of(t, ())
            assert found[i] == "\n\n".join(left)
    assert removed > 20


def clashes(df):
    """df with further columns of names that operators might use inside."""
    names = "_b _u _d _k _day _month _url url_ day row best best_url best_day entry listed month asked_month host hashes tree trees n pages page digest first value payload record_id problem offset path vec ids point block leaf name".split()
    return df.select("*", *[warc.F.lit(f"own {i}").alias(x) for i, x in enumerate(names) if x not in df.columns])


def test_columns_that_clash(spark):
    rows = pages_of(spark, 12)
    pages = clashes(spark.createDataFrame(rows, PAGES))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    plain = pages.select("page_id", "url", "html")
    assert same(html_text.main_texts(pages), html_text.main_texts(plain)) and same(warc.round_trip(pages), warc.round_trip(plain))
    table = spark.createDataFrame([("b", "block", "add", datetime.date(2024, 1, 1))], url_lists.CHANGES)
    dated = pages.withColumn("fetched", warc.F.lit(datetime.date(2024, 2, 1)))
    found = url_lists.judge(dated, table)
    assert [c for c in found.columns if c not in ("decision", "entry", "since", "until")] == [c for c in dated.columns if c != "entry"]
    assert {r._b for r in found.collect()} == {"own 0"} and found.where("decision = 'block'").count() == 1 and found.count() == len(rows)
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert same(neighbours.search(clashes(vectors)), neighbours.search(vectors))


def test_archives_are_cut_by_bytes_and_gaps_fail_the_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "http://a/", "".join(chr(rng.randint(33, 9000)) for _ in range(rng.choice([5, 2000, 9000])))) for i in range(60)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "out"), most=20_000)
    files = [p.stat().st_size for p in (tmp_path / "out").glob("part-*")]
    assert len(files) > 10 and max(files) < 40_000 and sum(n > 20_100 for n in files) <= sum(len(h.encode()) > 19_000 for _, _, h in rows)
    assert warc.records(warc.read(spark, str(tmp_path / "out"))).count() == 60
    real = warc.record
    monkeypatch.setattr(warc, "write", lambda pages, path: (tmp_path / "bad").mkdir() or (tmp_path / "bad" / "x").write_bytes(real("response", "1", "u", "d", "0" * 64, 3, b"abc")))
    monkeypatch.setattr(warc, "new_path", lambda *_: str(tmp_path / "bad"))
    with pytest.raises(Exception, match="gap in"):
        warc.round_trip(spark.createDataFrame(rows[:1], PAGES)).collect()


def test_templates_of_a_host_go(spark):
    rows = [(i, f"http://User@Host.example:80/{i}", f"<div><div><b>Our shop</b> sells <i>things</i></div><p>Story {i} of {i * 7}</p><p>The.</p><div>Call us</div></div>") for i in range(20)]
    rows += [(100 + i, f"http://small.example/{i}", "<div>Our shop</div><p>same</p>") for i in range(5)]
    rows += [(200 + i, "http://copies.example/a", "<p>A copied story</p><p>and its end</p>") for i in range(30)]
    rows += [(300, None, "<p>a</p>"), (301, "no address", None), (301, "no address", None), (None, "http://host.example/x", "<div>Call us</div><p>null id</p>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", html_text.F.lit(0))
    rule = html_text.Template(pages=10, share=0.5)
    found = html_text.main_texts(pages, rule).toPandas()
    by_id = found.drop_duplicates("page_id").set_index("page_id")["text"]
    assert len(found) == len(rows) and (found.n_chars == found.text.str.len()).all()
    assert by_id[3] == "Story 3 of 21" and by_id[100] == "Our shop\n\nsame" and by_id[200] == "A copied story\n\nand its end"
    assert by_id[300] == "a" and by_id[301] == "" and found[found.page_id.isna()].text.tolist() == ["null id"]
    assert html_text.main_texts(pages.limit(0), rule).count() == 0


def pages_of(spark, n=40):
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 3}.example/ {i}\r\n", "".join(rng.choice("abé<>\n\r ") for _ in range(rng.randint(0, 400)))) for i in range(n)]
    rows += [(100 + i, "http://a/", "<p>the same long page</p>" * 20) for i in range(6)] + [(200, None, None), (201, "", ""), (202, "u", "short"), (203, "u", "short"), (99, "http://b/", "<p>the same long page</p>" * 20)]
    return rows


def test_archives_come_back_whole(spark, tmp_path):
    rows = pages_of(spark)
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", warc.F.lit(1))
    found = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(found) == len(rows)
    firsts = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        firsts.setdefault(h or "", i)
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 100 and firsts[h or ""] != i
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (found[i].record_type, found[i].refers_to) == (("revisit", firsts[h]) if again else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    back = warc.records(warc.read(spark, path))
    assert {(r.record_id, bytes(r.payload)) for r in back.collect() if r.record_type == "response"} == {(str(i), (h or "").encode()) for i, _, h in rows if found[i].record_type == "response"}
    assert warc.gaps(warc.read(spark, path)).count() == 0


def test_pages_of_damaged_archives(spark):
    rows = pages_of(spark, 90) + [(1, "http://twice/", "bytes change"), (9, "http://twice/", "noise")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("last", warc.F.lit(1)).repartition(3)
    found = warc.salvaged(pages).collect()
    assert sorted(str(r.page_id) for r in found) == sorted(str(i) for i, _, _ in rows)
    firsts = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        firsts.setdefault(h or "", i)
    bodies = [(i, (h or "").encode(), len((h or "").encode()) >= 100 and firsts[h or ""] != i) for i, _, h in rows]
    problems = {warc.BYTES_CHANGE: "broken member", warc.CUT: "broken member", warc.LENGTH: "length does not lead to the record's end", warc.DIGEST: "payload digest"}
    want = []
    for i, body, again in bodies:
        problem = problems.get(i % warc.DRILL) if i % warc.DRILL != warc.DIGEST or not again else None
        kept = ("revisit" if again else "response", len(body), hashlib.sha256(body).hexdigest()) if problem is None else (None, None, None)
        want.append((i, *kept, "no version line" if i % warc.DRILL == warc.NOISE else problem))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert warc.salvaged(pages.limit(0)).count() == 0


def members(n=12):
    return [warc.record("response", str(i), "http://x/", "2024-01-01T00:00:00Z", __import__("hashlib").sha256(b := f"page {i} WARC/1.1\r\n\x1f\x8b\x08".encode() * 9).hexdigest(), len(b), b) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_loses_only_what_is_broken(packed):
    whole = [gzip.compress(m) if packed else m for m in members()]
    starts = np.cumsum([0, *map(len, whole)])
    data = b"".join(whole)
    assert [r["record_id"] for _, _, p, r in warc.salvage(data)] == [str(i) for i in range(12)]
    rng = random.Random(1)
    for _ in range(60):
        hit, broken = rng.randrange(12), bytearray(data)
        at = int(starts[hit]) + rng.randrange(len(whole[hit]) // 4, len(whole[hit]) - 8)
        kind = rng.choice(["flip", "cut", "insert"])
        if kind == "flip":
            broken[at : at + 3] = bytes(x ^ 0xFF for x in broken[at : at + 3])
        elif kind == "cut":
            del broken[at : int(starts[hit + 1]) - 2]
        else:
            broken[at:at] = b"\x00\xffnoise\n" * 3
        found = list(warc.salvage(bytes(broken)))
        kept = [r["record_id"] for _, _, p, r in found if r]
        assert set(kept) >= {str(i) for i in range(12) if i != hit} and kept == sorted(kept, key=int)
        assert sum(n for _, n, _, _ in {(o, n, p, None) for o, n, p, _ in found}) == len(broken)
    ends = list(warc.salvage(data[:-7]))
    assert [r["record_id"] for _, _, _, r in ends if r] == [str(i) for i in range(11)] and ends[-1][2]
    assert list(warc.salvage(b"")) == [] and [x[2] is None for x in warc.salvage(b"junk")] == [False]


def test_salvage_inside_members_of_several_records():
    parts = members(9)
    ids = lambda found: [r["record_id"] for _, _, p, r in found if not p]
    assert ids(warc.salvage(gzip.compress(b"".join(parts)))) == [str(i) for i in range(9)]
    bad = [*parts]
    bad[4] = bad[4].replace(b"page 4", b"page X")
    data = gzip.compress(b"".join(bad)) + gzip.compress(parts[0])
    found = list(warc.salvage(data))
    assert ids(found) == ["0", "1", "2", "3", "5", "6", "7", "8", "0"]
    gap = [(p, r) for _, _, p, r in found if p]
    assert gap == [("payload digest", {"inner_offset": sum(map(len, parts[:4])), "inner_length": len(parts[4])})]
    whole = gzip.compress(b"".join(parts), 0)  # stored, so that a place in the archive is one in the text
    cut = whole[: sum(map(len, parts[:6])) + 40]
    found = list(warc.salvage(cut + gzip.compress(parts[8])))
    assert ids(found) == ["0", "1", "2", "3", "4", "5", "8"] and sum(n for _, n, p, _ in found if p) == len(cut)
    found = list(warc.salvage(cut))
    assert ids(found) == ["0", "1", "2", "3", "4", "5"] and [(o, n, p) for o, n, p, _ in found if p] == [(0, len(cut), "member is cut off")]
    plain = [warc.record("revisit", str(i), "", "2024-01-01T00:00:00Z", "00", 3, b"", "1") for i in range(3)]
    damaged = gzip.compress(b"".join(plain))[:-8] + b"\0" * 8
    assert ids(warc.salvage(damaged)) == [] and ids(warc.salvage(damaged + gzip.compress(parts[3]))) == ["3"]


def test_gaps_of_archives_read_by_spark(spark, tmp_path):
    parts = members(7)
    bad = [*parts]
    bad[2] = bad[2].replace(b"page 2", b"page X")
    (tmp_path / "a.warc").write_bytes(gzip.compress(b"".join(bad)) + b"noise" + gzip.compress(parts[0]))
    found = warc.read(spark, str(tmp_path))
    assert sorted(r.record_id for r in warc.records(found).collect()) == ["0", "0", "1", "3", "4", "5", "6"]
    gaps = [(r.length, r.problem, r.inner_length) for r in warc.gaps(found).orderBy("offset").collect()]
    assert gaps == [(0, "payload digest", len(parts[2])), (5, "no version line", None)]


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    x = np.concatenate([rng.standard_normal((1500, 24)), centres[rng.integers(0, 30, 1500)] + 0.2 * rng.standard_normal((1500, 24))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, name int")
    found = neighbours.search(rows, block=256).toPandas()
    d = x.astype(float)
    unit = d / np.sqrt((d * d).sum(axis=1))[:, None]
    hits = 0
    for query, part in found.groupby("query_id"):
        score = unit @ unit[query]
        score[query] = -9
        hits += len(set(part.vec_id) & set(np.argsort(-score)[:5]))
        part = part.sort_values("rank")
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(part.score, score[part.vec_id], atol=1e-12) and (np.diff(part.score) <= 0).all()
    assert found.query_id.nunique() == 60 and hits / 300 >= 0.95
    assert (found.n_verified > 5).all() and found.drop_duplicates("query_id").n_verified.mean() < 1500


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_generated_vectors(spark, table):
    path = f"/root/testdata/{table}/embeddings.parquet"
    if not Path(path).exists():
        pytest.skip("no generated tables")
    rows = spark.read.parquet(path)
    found, table = neighbours.search(rows).toPandas(), rows.toPandas().set_index("vec_id")
    unit = np.stack(table.embedding.to_numpy()).astype(float)
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    hits = 0
    for query, part in found.groupby("query_id"):
        score = unit @ unit[table.index.get_loc(query)]
        best = table.index[np.argsort(-score)[:6]]
        hits += len(set(part.vec_id) & set(best[best != query]))
    assert hits / (5 * found.query_id.nunique()) >= 0.9


def test_large_cells_are_cut_on(spark, monkeypatch):
    """More rows than CELLS blocks hold, and half of all vectors of one direction."""
    monkeypatch.setattr(neighbours, "CELLS", 2)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((600, 6)), np.outer(rng.random(600) + 0.5, np.arange(1.0, 7.0))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(neighbours, "blocks_of", lambda *a, keep=neighbours.blocks_of: seen.append(keep(*a)) or seen[-1])
    found = neighbours.search(rows, block=32).toPandas()
    sizes = seen[0].groupBy("block").count().toPandas()["count"]
    assert sizes.sum() == 1200 and sizes.max() < 150 and len(sizes) > 20
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    for query, part in found[found.query_id < 600].groupby("query_id"):
        score = unit @ unit[query]
        score[query] = -9
        assert len(set(part.vec_id) & set(np.argsort(-score)[:5])) >= 4
    assert found.query_id.nunique() == 24 and (found[found.query_id >= 600].score > 1 - 1e-9).all()
    with pytest.raises(ValueError):
        neighbours.search(rows, dimensions=5)


def test_neighbours_of_awkward_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 120)] + [(200, None), (250, [0.0, 0.0]), (300, [1.0, None]), (350, [float("nan"), 1.0]), (400, [1.0]), (None, [1.0, 1.0]), (450, [0.0, 2.0]), (450, [0.0, 2.0]), (451, [1.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(table).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 450: [451, 0, 1, 2, 3]}
    assert neighbours.search(table.limit(0)).count() == 0
    assert neighbours.search(table.where("vec_id in (450, 451)")).count() == 1


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 2) - 5.991) < 1e-3 and abs(neighbours.chi_square_quantile(0.99, 12) - 26.217) < 1e-3


def test_kd_tree_cells_are_even_and_agree():
    points = np.random.default_rng(1).standard_normal((5000, 4))
    cells = neighbours.cell_of(points, neighbours.kd_splits(points, 16))
    assert np.bincount(cells, minlength=16).min() > 250 and set(cells) == set(range(16))
    assert neighbours.cell_of(points, []).tolist() == [0] * 5000


def test_lists_have_a_history(spark):
    day = datetime.date.fromisoformat
    changes = [("bad.example", "block", "add", "2024-01-10"), ("bad.example", "block", "add", "2024-01-20"), ("bad.example", "block", "remove", "2024-03-05"), ("Bad.Example/", "block", "add", "2024-06-01"), ("ok.bad.example", "allow", "add", "2024-01-15"), ("x.example/a", "block", "add", "2024-01-01"), ("x.example", "allow", "add", "2024-01-01"), ("tie.example", "allow", "add", "2024-01-01"), ("tie.example", "block", "add", "2024-01-01"), ("same.example", "block", "add", "2024-01-01"), ("same.example", "block", "remove", "2024-01-01"), (None, "block", "add", "2024-01-01"), ("gone.example", "block", "remove", "2024-01-01"), ("y.example", "odd", "add", "2024-01-01")]
    table = spark.createDataFrame([(e, k, a, day(d)) for e, k, a, d in changes], url_lists.CHANGES)
    spans = {(r.entry, r.kind, str(r.since), str(r.until)) for r in url_lists.intervals(table).collect()}
    assert {s for s in spans if s[0] == "bad.example"} == {("bad.example", "block", "2024-01-10", "2024-03-05"), ("bad.example", "block", "2024-06-01", "None")}
    asked = [("http://bad.example/", "2024-01-09", "none"), ("http://BAD.example:80/", "2024-01-10", "block"), ("https://u@www.bad.example/q?x", "2024-03-04", "block"), ("http://bad.example", "2024-03-05", "none"), ("http://bad.example", "2024-07-01", "block"), ("http://notbad.example/", "2024-02-01", "none"), ("http://ok.bad.example/", "2024-02-01", "allow"), ("http://ok.bad.example/", "2024-01-12", "block"), ("http://x.example/A/b", "2024-02-01", "block"), ("http://x.example/ab", "2024-02-01", "allow"), ("http://tie.example/", "2024-02-01", "allow"), ("http://same.example/", "2024-02-01", "block"), (None, "2024-02-01", "none"), ("http://bad.example", None, "none"), ("junk", "2024-02-01", "none")]
    captures = spark.createDataFrame([(i, u, day(d) if d else None, "old") for i, (u, d, _) in enumerate(asked)] * 2, "page_id long, url string, fetched date, decision string")
    found = url_lists.judge(captures, table).collect()
    assert len(found) == 2 * len(asked)
    assert {r.page_id: r.decision for r in found} == {i: want for i, (_, _, want) in enumerate(asked)}
    assert {r.decision for r in url_lists.judge(captures, table.limit(0)).collect()} == {"none"}
    assert url_lists.judge(captures.limit(0), table).count() == 0
