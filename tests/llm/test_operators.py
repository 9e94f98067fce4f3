"""Corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import time
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import html_text, line_dedup, media, mixing, near_dup, packing, registry, secrets, substring_dedup, syncmers, toxicity
from clausewright.llm.components import connected

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, k string, t string, node long, size long, key long"
LONG = " ".join(f"w{i % 977} x{i % 31}." + ("\n" if i % 50 == 0 else "") for i in range(20_000))


def odd_rows():
    rows = [(1, None, "s"), (2, "", "s"), (3, LONG, None), (4, "same line\nb", "s"), (4, "same line\nb", "s"), (None, "no id", "t"), (None, None, None), (5, "\n\n", "u"), (6, "é Password: 'abcdef1'", "u")]
    return [(i, t, None, s, 7, 1, "k", "t", 2, 3, 4) for i, t, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def run_all(docs, labels):
    model = toxicity.fit(docs, labels)
    return {
        "pack": packing.pack_documents(docs, packing.default_tokenizer()).groupBy("doc_id").agg(F.sum("length")).count(), "html": html_text.extract_main_text(docs.withColumnRenamed("text", "html")).count(),
        "lines": line_dedup.dedup_lines(docs).count(), "syncmers": syncmers.fingerprint_pairs(docs).count(), "repeats": substring_dedup.remove_repeats(docs).count(), "near": near_dup.near_groups(docs).count(),
        "toxic": toxicity.score_toxicity(docs, model).count(), "secrets": secrets.secret_spans(docs).count(), "mix": mixing.sample_mix(docs).count(), "media": media.media_columns(docs).count(),
    }


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1, None), (4, 1, 1), (None, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = run_all(odd, labels)
    assert got.pop("pack") == 7 and set(got.values()) == {9}
    empty = odd.limit(0)
    assert set(run_all(empty, labels.limit(0)).values()) == {0}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(registry.ORACLES[name]).df()[list(got.columns)]
    order = list(got.columns)
    assert got.sort_values(order).to_numpy().tolist() == want.sort_values(order).to_numpy().tolist()


def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


def test_packing(spark):
    docs, store = texts(), packing.WordIds(packing.default_tokenizer())
    rows = registry.QUERIES["op1_packing"](spark, DATA).toPandas()
    for doc, piece in rows.sort_values("start").groupby("doc_id"):
        ids, at = store.whole(docs[doc]) + packing.END, 0
        for r in piece.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) // 4 and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4
    assert set(rows["doc_id"]) == set(docs)
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and bin(seq["length"].sum()).count("1") == 1


def test_word_store_equals_whole_encoding():
    store, rng = packing.WordIds(packing.default_tokenizer()), random.Random(1)
    parts = ["a", "The", "é", ".", ",", " ", "  ", "\n", "\t", "'s", "1", "日本", "<|endoftext|>", "_", "x.", " .", "\r\n", "　"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert store.ids([t]) == [store.whole(t)], t


def test_hilbert_curve_visits_neighbours():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys((grid + 0.5) / 8, 3)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_html():
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><a href=/>Menu entry</a></nav><div class='ad box'>Buy this now, it is good</div><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>A &amp; B</h1><p>First   para with <b>bold</b> and <a href=x>a link</a> text that is long enough.<p>Short.<ul><li>One<li>Two</ul><script>x='</p>'</script><p>Last&nbsp;one</article>"
        "<div id='comments'><p>A reader says something rather long here, which is not the article.</p></div><footer>&copy; me</footer>"
    )
    assert html_text.main_text(page) == "A & B\n\nFirst para with bold and a link text that is long enough.\n\nShort.\n\nOne\n\nTwo\n\nLast one"
    plain = "<body><ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a>" for i in range(9)) + "</ul><div><p>" + "Real words of the story go on. " * 9 + "</p><p>" + "More of the story follows. " * 8 + "</p></div></body>"
    got = html_text.main_text(plain)
    assert "Real words" in got and "More of the story" in got and "Entry" not in got
    assert html_text.main_text("") == "" and html_text.main_text("<nav>x</nav>") == "" and html_text.main_text("just text") == "just text"


def test_html_after_unknown_declarations():
    body = "<article><p>The first words of the story.</p>{}<p>The last words of the story.</p></article>"
    want = "The first words of the story.\n\nThe last words of the story."
    for odd in ("<![foo[ x ]]>", "<![ y>", "<![>", "<![1]>", "<![cdata-x[z]]>", "<![if !IE]>", "<![CDATA[ x > y ]]>", "<!foo>"):
        assert html_text.main_text(odd + body.format("")) == want and html_text.main_text(body.format(odd)) == want, odd
        for n in range(65500, 65540):  # the declaration lies across two pieces
            assert html_text.main_text("<!--" + "x" * n + "-->" + odd + body.format("")) == want, (odd, n)
    assert html_text.main_text("<![CDATA[ never ended>" + body.format("")) == want


def test_html_in_marked_wrappers():
    long, side = ["The first words of the story go on for a while. " * 5, "The last words of the story go on for a while. " * 4], "<div class=sidebar><p>Read this too.</p></div>"
    story = "".join(f"<p>{x.strip()}</p>" for x in long)
    want = "\n\n".join(x.strip() for x in long)
    for wrap in ("<div class='content has-sidebar'>{}</div>", "<div id=content-sidebar-wrap>{}</div>", "<div class='page no-ads'>{}</div>", "<section class='post with-comments'>{}</section>", "<div role=form>{}</div>", "<div class=no-ads><div class=has-sidebar>{}</div></div>"):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", f"<div>{story}</div>"):
            assert html_text.main_text("<body>" + wrap.format(inner + side) + "<div class=comments><p>A reader speaks.</p></div></body>") == want, (wrap, inner)
    comments = "<div class=comments>" + "".join(f"<article><p>{x}</p></article>" for x in long) + "</div>"
    assert html_text.main_text("<article><p>A short story of few words.</p></article>" + comments) == "A short story of few words."


def test_html_regions():
    long = {n: ("The story goes on and on for a while. " * 30)[:n].strip() for n in (18, 60, 640, 650, 700, 720)}
    parts = [long[60], long[700], long[650], *[long[18]] * 8, long[720], long[640]]
    story, want = "".join(f"<p>{x}</p>" for x in parts), "\n\n".join(parts)
    top, end = "<div class=top><p>My site</p></div><ul><li><a href=/>Home</a></ul>", "<div class=legal><p>All rights are ours</p></div>"
    assert html_text.main_text(f"<body>{top}<div>{story}</div>{end}") == want
    end = "<ul>" + "<li><a href=/>Home</a>" * 4 + "</ul>" + end
    assert html_text.main_text(f"<body>{top}<div class=a>{story}</div><div class=b>{story}</div>{end}") == want + "\n\n" + want
    teaser = "<div class=teaser><h3>More to read</h3><ul>" + "".join(f"<li><a href=/{i}>Another story {i}</a> 3 notes" for i in range(5)) + "</ul></div><p><a href=/all>All of our stories</a></p><div class=box>Join us <a href=/j>here and now</a></div>"
    half = story.index("<p>", 900)
    for page in ("<article>{}</article>", "<body>" + top + "<main>{}</main>" + end, "<div>{}</div>"):
        assert html_text.main_text(page.format(story + teaser)) == want and html_text.main_text(page.format(story[:half] + teaser + story[half:])) == want, page
    text = f"<h1><a href=/s>The story</a></h1>{story}<ul><li>One<li>Two</ul><p>See <a href=/n>n</a> too.</p>"
    assert html_text.main_text(f"<article>{text}</article>") == f"The story\n\n{want}\n\nOne\n\nTwo\n\nSee n too."


def test_fingerprints(spark):
    docs = texts()
    rows = {r["doc_id"]: r for r in registry.QUERIES["op4_fingerprints"](spark, DATA).collect()}
    order = sorted(docs, reverse=True)
    for a, b in pairwise([*order, order[0]]):
        m = len(docs[a]) // 3
        edited = (docs[a][: len(docs[a]) - m] + docs[b][:m]).encode()
        assert rows[a]["edited_sha256"] == hashlib.sha256(edited).hexdigest() and rows[a]["n_chars"] == len(docs[a])
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.35 > 0.1 > np.mean([r["near_next"] for r in rows.values()])
    shifted = syncmers.anchors(b"prefix " + LONG.encode())[1]
    assert np.isin(syncmers.anchors(LONG.encode())[1], shifted).mean() > 0.99


def test_passages_of_long_texts(spark):
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    shared, a, b, c, d = make(50), make(9000), make(4000), make(9000), make(6000)
    docs = {2: f"{a} {shared} {b}", 1: f"{c} {shared} {d}", 0: "é"}
    rows = {r["doc_id"]: r for r in syncmers.fingerprint_pairs(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    for doc, t in docs.items():
        places, hashes = syncmers.anchors(t.encode())
        assert rows[doc]["anchor_places"] == places.tolist() and rows[doc]["anchor_hashes"] == hashes.view(np.int32).tolist()
    (got,) = rows[2]["passages_next"]
    assert abs(got["place"] - len(a)) < 40 and got["other"] - got["place"] == len(c) - len(a) and got["anchors"] > 40
    assert 0 < rows[2]["near_next"] < 0.01 and rows[1]["near_next"] == 0 and rows[1]["passages_next"] == []
    for x, y in ((docs[2], docs[1]), ("abcab" * 30, "cabca" * 9), (shared * 3, shared), (a[:900], a[300:1200] + a[:500])):
        (px, hx), (py, hy) = syncmers.anchors(x.encode()), syncmers.anchors(y.encode())
        pairs = [set(zip(h[:-1].tolist(), h[1:].tolist(), np.diff(p).tolist(), strict=True)) for p, h in ((px, hx), (py, hy))]
        held = [{k for i, g in enumerate(zip(h[:-1].tolist(), h[1:].tolist(), np.diff(p).tolist(), strict=True)) if g in pairs[0] & pairs[1] for k in (i, i + 1)} for p, h in ((px, hx), (py, hy))]
        near, passages = syncmers.matched((px, hx), (py, hy))
        same = min(map(len, held))
        assert near == same / (len(hx) + len(hy) - same) and passages[:, 2].sum() == len(held[0])
        for place, other, n in passages.tolist():
            i, j = np.searchsorted(px, place), np.searchsorted(py, other)
            assert (hx[i : i + n] == hy[j : j + n]).all() and (px[i : i + n] - place == py[j : j + n] - other).all()


def brute_repeats(docs, n=13):
    first, words = {}, {d: docs[d].encode().split() for d in sorted(docs)}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        out[d] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def test_repeats(spark):
    rng, docs = random.Random(5), {}
    for i in range(150):
        few = rng.choice([1, 2, 3, 30])
        t = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCD"[:few]) for _ in range(rng.randint(0, 80)))
        if docs and rng.random() < 0.5:
            old = rng.choice(list(docs.values())).split()
            at = rng.randint(0, len(old))
            t += " " + " ".join(old[at : at + rng.randint(5, 40)])
        docs[i * 3] = t
    docs |= {1000 + d: t for d, t in texts().items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute_repeats(docs)


def brute_groups(docs, n, percent):
    sets = {d: frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else []) for d, t in docs.items() for w in [t.encode().lower().split()]}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


def test_near_groups(spark):
    rng, docs = random.Random(2), texts()
    base = [f"word{rng.randint(0, 400)}" for _ in range(60)]
    for i in range(120):  # one family of near copies, with links of all degrees
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"new{rng.randint(0, 99)}"
        docs[10_000 + i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for n, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_groups(df, n=n, percent=percent).collect()}
        assert got == brute_groups(docs, n, percent)


def test_near_groups_without_ids(spark):
    rng = random.Random(6)
    a, b, c, d, e = ([f"word{rng.randint(0, 9999)}" for _ in range(60)] for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, a), (None, a), (None, b), (None, near(b).split()), (None, b), (None, c), (5, d), (5, d), (5, e), (7, near(e).split()), (None, []), (None, [])]
    rows = [(i, " ".join(w), n) for n, (i, w) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    got = near_dup.near_groups(df).collect()
    assert sorted((r["component_id"] or 0, r["kept"]) for r in got) == sorted([(1, True), (1, False), (0, True), (0, False), (0, False), (0, True), (5, True), (5, False), (5, True), (5, False), (0, True), (0, True)])
    left = near_dup.drop_near_duplicates(df)
    assert left.columns == df.columns
    kept = sorted(r["n"] for r in left.collect())
    assert len(kept) == 7 and {0, 5, 8, 10, 11} < set(kept) and len({2, 3, 4} & set(kept)) == 1 and len({6, 7} & set(kept)) == 1


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    for n in (5, 40, 300, 2000):
        off = []
        for _ in range(20):
            k = n // 2
            a = rng.integers(0, 2**63, 2 * n - k).astype(np.uint64)
            s = near_dup.super_minhash([a[:n], a[n - k :]])
            off.append((s[0] == s[1]).mean() - k / (2 * n - k))
        assert abs(np.mean(off)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        parts = [" ".join(rng.choices(plain, k=8)) + "." for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(parts))
            parts[at] = "you utter blockhead " + parts[at]
        rows.append((i, " ".join(parts)))
        labels.append((i, 0, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert len(held) > 60 and all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    for r in held:
        if r["worst"]:
            assert "blockhead" in rows[r["doc_id"]][1][r["worst"]["start"] : r["worst"]["stop"]]
    assert toxicity.drop_toxic(docs, model).count() == 450


RULES = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6), "access": (re.compile("AKIA[A-Z0-9]+"), 20), "hex": (re.compile("[0-9a-f]+"), 24)}


def test_secrets():
    rng = random.Random(3)
    parts = ["password", "passwd", "secret", "token", "api_key", "APIKEY", "Token", '"', "'", " ", "  ", ":", "=", "==", "abc", "abcdef", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é", "\n", "x", "-", ".", "ghp_"]
    for t in [*texts().values(), *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(10_000))]:
        want = sorted((m.start(), i, m.end(), k) for i, (k, (p, least)) in enumerate(RULES.items()) for m in p.finditer(t) if len(m[2] if k == "assign" else m[0]) >= least)
        assert [s for s in secrets.spans(t) if s[0] in RULES] == [(k, a, b) for a, _, b, k in want], t
    assert secrets.spans("é ghp_" + "Zk" * 18 + " -----BEGIN RSA PRIVATE KEY-----") == [("hub", 2, 42), ("pem", 43, 74)]


def test_mixing_meets_targets(spark):
    rows = registry.QUERIES["op9_mixing"](spark, DATA).toPandas()
    docs = duckdb.sql(f"SELECT doc_id, source FROM '{DATA}/documents.parquet'").df()
    per = rows.merge(docs, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), told=("source_size", "first"))
    assert (abs(per["taken"] - per["target"]) <= 1).all() and (per["size"] == per["told"]).all() and (per["target"] <= 3 * per["size"]).all() and (rows["taken"] <= 3 * rows["size"]).all()
    assert abs(per["target"].sum() - per["size"].sum()) < 1e-3
    assert rows.equals(registry.QUERIES["op9_mixing"](spark, DATA).toPandas()) or sorted(map(tuple, rows.to_numpy())) == sorted(map(tuple, registry.QUERIES["op9_mixing"](spark, DATA).toPandas().to_numpy()))


def test_media(spark):
    for r in media.media_columns(spark.createDataFrame([(1, "abc" * 999), (2, None), (3, "x" * 576)], "doc_id long, text string")).collect():
        data = ("abc" * 999, "", "x" * 576)[r["doc_id"] - 1].encode()
        assert r["payload"][: len(data)] == data and set(r["payload"][len(data) :]) <= {255} and len(r["payload"]) % 576 == 0 < len(r["payload"])
        assert media.from_wav(r["media"]) == r["payload"] and r["landmarks"] == sorted(r["landmarks"]) and r["landmarks"]


def test_html_takes_time_in_proportion():
    """Four times the page takes about four times as long, whatever is left open in it."""
    pages = {
        "no tag end": lambda n: "<p>" + ("x " * 50 + "<") * (n // 101), "no start tag end": lambda n: "<p>" + ("x " * 50 + "<b ") * (n // 103), "no comment end": lambda n: "<p>a</p>" + "<!-- x > " * (n // 9),
        "open b": lambda n: "<b>" * (n // 16) + "<p>x</p>" * (n // 16), "marks in marks": lambda n: "<div class=ad>x" * (n // 15), "no section end": lambda n: "<![CDATA[ x > " * (n // 14),
    }
    for name, page in pages.items():
        took = []
        for n in (500_000, 2_000_000):
            html, began = page(n), time.process_time()
            html_text.main_text(html)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 1, (name, took)
    assert html_text.main_text("<p>one <b class='x") == "one <b class='x" and html_text.main_text("<p>a &lt; b</p> c < d &amp; e") == "a < b\n\nc < d & e"


def test_html_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, "a", "b"), (2, "", "c", None), (2, "<p>x", "d", "e"), (None, "<p>x", "d", "e")], "page_id long, html string, __html string, text string")
    got = sorted(((r["page_id"], r["text"], r["__html"]) for r in html_text.extract_main_text(rows).collect()), key=str)
    assert got == sorted([(1, "", "a"), (2, "", "c"), (2, "x", "d"), (None, "x", "d")], key=str)


def test_rows_without_ids_and_equal_short_hashes(spark):
    """Two unlike texts whose 32-bit hashes are equal, without ids: neither loses words for the other's repeats."""
    rng = random.Random(5)
    p, q = (" ".join(f"{c}{rng.randint(0, 10**6)}" for _ in range(60)) for c in "pq")
    many = spark.range(90_000).select(F.concat(F.lit(f"{p} n"), "id").alias("a"), F.concat(F.lit(f"{q} m"), "id").alias("b"))
    pair = many.select("a", F.hash("a").alias("h")).join(many.select("b", F.hash("b").alias("h")), "h").select("a", "b").first()
    assert pair is not None
    rows = spark.createDataFrame([(1, p), (None, pair["a"]), (None, pair["b"])], "doc_id long, text string")
    got = {r["kept_text"]: r["n_removed"] for r in substring_dedup.remove_repeats(rows).collect()}
    assert got == {p: 0, pair["a"].split()[-1]: 60, pair["b"]: 0}


def test_mixing_leaves_of_junk_sources_stay_small(spark):
    """Documents of the least quality spread over as many leaves as others."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("1234 5678").alias("text"), F.lit("tables").alias("source")).union(spark.range(40_000).select(F.col("id"), F.lit("some words"), F.lit("prose")))
    for q in (0.05, 1.0):
        key = -F.log(F.rand(3)) / q
        most = spark.range(40_000).select(F.floor((F.log2(key) + 54) * 1024).alias("leaf")).groupBy("leaf").count().agg(F.max("count"), F.min("leaf"), F.max("leaf")).first()
        assert most[0] < 60 and most[1] >= 0 and most[2] < 65_536
    got = mixing.sample_mix(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r["taken"] == round(r["target"]) for r in got) and len(got) == 2


def test_lines_keep_columns_of_any_name(spark):
    rows = [(i, "a line\nown {i}", "x", "y") for i in range(12)] + [(None, "a line\nb", "x", "y"), (None, "a line\nc", "x", "y")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, __line_id string, __line_th string"))
    assert got.columns == ["doc_id", "text", "__line_id", "__line_th", "n_lines", "n_dropped", "kept_text"]
    assert sorted(r["kept_text"] for r in got.filter("doc_id is null").collect()) == ["b", "c"] and {r["__line_id"] for r in got.collect()} == {"x"}
