"""Periodic runs, the prefix trie and page texts against brute force and in odd cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathomline.llm import line_blocks, periodic, prefixes, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(800):
        n, k = rng.randrange(0, 120), rng.choice([1, 2, 2, 3, 5, 40])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 3:
                a = rng.randrange(n)
                p = rng.randrange(1, n // 2 + 1)
                for i in range(a, rng.randrange(a, n)):
                    w[i] = w[a + (i - a) % p]
        numbers = {}
        ids = np.array([numbers.setdefault(x, len(numbers)) for x in w], dtype=np.int64)
        assert list(zip(*(x.tolist() for x in periodic.runs_of(ids)), strict=True)) == brute_runs(w)


def test_long_periodic_texts_are_quick():
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    began = time.perf_counter()
    for ids in (np.zeros(200_000), np.tile(np.arange(37), 5_000), np.array(b), np.arange(300_000)):
        periodic.runs_of(ids.astype(np.int64))
    assert time.perf_counter() - began < 15


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_runs_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        w = WORD.findall(texts[r["doc_id"]] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 500:  # the brute force is cubic
            continue
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(w, runs)).encode()).hexdigest()


def test_runs_odd_rows(spark):
    long = "x y z " * 30_000
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (None, "a " * 12, 7), (4, long, 7), (5, "a\tb\n" * 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periodic.periodic(docs)
    assert got.columns == ["doc_id", "text", "runs", "n_words", "runs_", "collapsed"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append((r["n_words"], [tuple(x) for x in r["runs_"]], r["collapsed"]))
    assert by[1] == [(0, [], "")] and by[2] == [(0, [], "")] * 2
    assert by[None] == [(12, [(0, 12, 1)], "a")] and by[5] == [(12, [(0, 12, 2)], "a b")] and by[4] == [(90_000, [(0, 90_000, 3)], "x y z")]
    assert periodic.digests(periodic.periodic(docs.drop("runs").filter("false"))).count() == 0
    same = docs.select("doc_id", periodic.looped(docs["doc_id"], docs["text"]).alias("text")).collect()
    assert len(same) == len(rows) and [r["text"] for r in same if r["doc_id"] is None] == ["a " * 12]


def brute_trie(conversations, family=20, shared=4):
    own = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, key, text))
    own = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        built[c] = tuple(own.get(c - c % family, [])[:h] + t[h:])
    number, members, path = {}, defaultdict(list), {}  # node numbers by (parent, turn)
    for c, t in built.items():
        path[c] = [0]
        for turn in t:
            path[c].append(number.setdefault((path[c][-1], turn), len(number) + 1))
        for v in path[c]:
            members[v].append(c)
    parent, last = {v: p for (p, _), v in number.items()}, {v: t for (_, t), v in number.items()}
    kids = Counter(parent.values())
    leaves, saved = Counter(), Counter()
    for v, inside in members.items():
        up = v
        while up is not None:
            leaves[up] += not kids[v]
            saved[up] += (len(inside) - 1) * len(WORD.findall(last[v][1])) if v else 0
            up = parent.get(up)
    out = []
    for v, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if path[c][-1] == v)
        depth = path[inside[0]].index(v)
        out.append((min(inside), depth, min(members[parent[v]]) if v else None, len(inside), kids[v], leaves[v], saved[v], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string")
    got = prefixes.trie(*prefixes.rebuilt(prefixes.turns(frame)))
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_trie_equals_brute_force_in_odd_cases(spark):
    rng = random.Random(3)
    rows = [(None, 0, "user", "lost", "x"), (7, None, None, None, None), (7, None, "user", "a b", None), (7, 3, "user", "c", None), (7, 3, "user", "c", None), (7, 3, "bot", "d", None)]
    rows += [(61 + k, 0, "user", "alone", None) for k in range(18)]  # without the first of their family
    for c in range(100, 200):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello there", "what is it", "", None]), None))
    rows += [(c, t, "user", f"turn {t % 5}", None) for c in (300, 301, 302) for t in range(2500 if c == 300 else 2490)]  # longer than one piece
    assert trie_of(spark, rows) == brute_trie([r[:4] for r in rows])
    assert trie_of(spark, []) == []


def test_trie_copies_end_at_one_node_in_several_ranges(spark):
    ids = list(range(0, 40_000, 20))
    rows = [(c, t, "user", f"line {t}", None) for c in ids for t in range(3)]
    assert trie_of(spark, rows) == brute_trie([r[:4] for r in rows])


PAGES = {
    "blocks without marks": (
        "<html><head><title>T</title><body class='has-header'><div id=header><a href=/>Site</a> the best of all sites</div><div class=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>"
        "<div id=content><h1>Title &amp; more</h1><p>First paragraph of some length, which goes on and on until it is long enough to count.<p>Second<br>line &lt;ok&gt;.</p>"
        "<div class='ad-box'>Buy!</div><p>End.</p></div><div class=comments><p>A comment of great length, which goes on and on and on and on and on and on and on.</p></div>"
        "<form><label>Name</label><input></form><div id=footer>(c) 2001 Foo</div></body></html>",
        "Title & more\n\nFirst paragraph of some length, which goes on and on until it is long enough to count.\n\nSecond line <ok>.\n\nEnd.",
    ),
    "tables as layout": (
        "<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>Old page</h1>Text without paragraphs that is rather long, as old pages were, and it goes on like this.</td></tr></table>Copyright 1999 Me",
        "Old page\n\nText without paragraphs that is rather long, as old pages were, and it goes on like this.",
    ),
    "a form around the page": ("<body><form id=aspnetForm><div class=nav>x y z</div><h1>T</h1><p>Some paragraph of text here that is the content.</p></form></body>", "T\n\nSome paragraph of text here that is the content."),
    "marked": (
        "<header>site</header><main><header><h1>T</h1></header><article><p>Body\n a&nbsp;b.</p><aside>see also</aside><ul><li><a href=x>linked item</a></ul><article class=c><p>comment text</p></article>"
        "<footer>f</footer></article></main><aside><article>card</article></aside>",
        "T\n\nBody a b.\n\nlinked item",
    ),
    "a menu never closed": ("<nav><a href=1>x</a><article><h1>A</h1><p>b</article>", "A\n\nb"),
    "cut off": ("<article><p>hello <b>wor", "hello wor"),
    "scripts": ("<article><p>a <script>if (a<b) document.write('</p>');</script>b</p><!-- <p>no</p> --><style>p{}</style></article>", "a b"),
    "hidden": ("<article><p style='display:none'>no</p><p hidden>no</p><p title='a > b'>yes</p></article>", "yes"),
    "comments under a heading": ("<main><h1>T</h1><p>text</p><h2>3 comments</h2><p>me too</p></main>", "T\n\ntext"),
    "no markup": ("just text &copy; a < b", "just text © a < b"),
    "nothing": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("case", PAGES)
def test_page(case):
    page, text = PAGES[case]
    assert line_blocks.main_text(page) == text


def test_hostile_pages_are_quick():
    began = time.perf_counter()
    for page in ("<" * 300_000, '<a ="' * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<!--" * 100_000, "<button>" * 100_000, "<a b='" * 50_000 + '<a b="' * 50_000, "<div class=ad>" * 100_000 + "x", "<p>" * 200_000):
        line_blocks.main_text(page)
    assert time.perf_counter() - began < 15


def test_surge_and_dive():
    assert line_blocks.surges(np.array([0, 5, 90, 0, 0, 0, 40, 0]), 3, 80) == [(1, 3)]
    assert line_blocks.surges(np.array([0, 5, 9, 0, 0, 0, 40, 0]), 3, 80) == [(6, 7)]
    assert line_blocks.surges(np.array([50, 0, 0, 50, 9]), 3, 50) == [(0, 5)] and line_blocks.surges(np.array([50, 0, 0, 0, 50, 9]), 3, 50) == [(0, 1), (4, 6)]
    assert line_blocks.surges(np.zeros(4, dtype=int), 3, 80) == []


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = line_blocks.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "text_"] and sorted(tuple(r) for r in got.fillna("-").fillna(-1).collect()) == [(-1, "-", "-", ""), (1, "u", "t", "a"), (1, "u", "t", "a")]
    assert line_blocks.extracted(pages.filter("false")).count() == 0
