"""Packing, near-dedup, line dedup, HTML text, decontamination and the pipeline against brute force."""

import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbline.llm import common, components, decontam, html, lines, neardup, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(1 + i % 3)) for i in (rng.randrange(words) for _ in range(n)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([4, 30, 120, 400]), 3000) for _ in range(60)]
    texts = [None, "", " \n ", "one", "two words", *base, base[3], base[3].upper(), base[7] + " tail end here", prose(rng, 9000, 5000)]
    near = base[10].split()
    for k in range(40):  # a group whose members aren't all alike
        w = list(near)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


def library(text):
    from tokenizers import Tokenizer

    if not hasattr(library, "t"):
        library.t = Tokenizer.from_file(tokens.default_vocabulary())
    return np.array([*library.t.encode(text or "", add_special_tokens=False).ids, tokens.END], dtype="<u4")


# --- packing


def test_balanced_packing_covers_every_id_once(docs, corpus):
    found = defaultdict(list)
    sequences = defaultdict(list)
    for r in tokens.pack_balanced(docs).collect():
        found[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text, *_ in corpus:
        ids, at = library(text), 0
        for r in sorted(found[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens.WINDOW


def test_best_fit_packing_round_trip(docs, corpus):
    ids = defaultdict(dict)
    rows = tokens.pack_best_fit(docs).toPandas()
    for r in rows.itertuples():
        flat, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(flat) == r.n_tokens == r.cu_seqlens[-1] <= tokens.WINDOW
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            ids[doc][start] = flat[a:b]
    for i, text, *_ in corpus:
        assert np.array_equal(np.concatenate([ids[i][s] for s in sorted(ids[i])]), library(text))
    assert tokens.matrix(rows).shape == (len(rows), tokens.WINDOW)


def test_packings_handle_nulls_and_empty_tables(spark, docs):
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_tokens) for r in tokens.pack_balanced(odd).collect()) == [(False, 1), (False, 1), (True, 3)]
    assert tokens.pack_balanced(docs.limit(0)).count() == tokens.pack_best_fit(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=150))
def test_window_rules(lengths):
    for windows in (tokens.best_fit(lengths), tokens.balanced(lengths)):
        assert sorted(k for w in windows for k in w) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in w) <= 2048 for w in windows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_best_fit_equals_a_plain_search(lengths):
    """The same windows as trying every open window: the tightest that holds the item, of equal ones the last to reach that room."""
    windows, rooms = [], []  # (items), (room, when it was reached)
    for turn, k in enumerate(sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))):
        fits = [i for i, (room, _) in enumerate(rooms) if room >= lengths[k]]
        if fits:
            i = min(fits, key=lambda i: (rooms[i][0], -rooms[i][1]))
        else:
            i = len(windows)
            windows.append([])
            rooms.append((64, turn))
        windows[i].append(k)
        rooms[i] = (rooms[i][0] - lengths[k], turn)
    assert tokens.best_fit(lengths, 64) == windows


def plain_differencing(lengths, n):
    """Karmarkar-Karp by its definition, on lists."""
    parts = [(k, [(0, [])] * (n - 1) + [(size, [k])]) for k, size in enumerate(lengths)]
    born = len(lengths)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][-1][0] - p[1][0][0]), p[0]))
        (_, a), (_, b) = parts[:2]
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        parts[:2] = [(born, sorted(both, key=lambda w: w[0]))]
        born += 1
    return sorted(w[0] for w in parts[0][1]) if parts else [0] * n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.integers(1, 6))
def test_differencing_equals_its_definition(lengths, n):
    windows, heaviest = tokens.differencing(lengths, n)
    sums = sorted(sum(lengths[k] for k in w) for w in windows)
    assert heaviest == sums[-1]
    assert sums == plain_differencing(lengths, n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=30))
def test_windows_rise_only_while_one_is_over_capacity(lengths):
    made, n = tokens.balanced(lengths, 64), -(-sum(lengths) // 64)
    while max(plain_differencing(lengths, n)) > 64:
        n += 1
    assert len(made) == min(n, len(lengths))


def test_groups_balance_without_more_windows():
    """Groups as documents fill them: all 32 windows hold nearly the same, and none more than its capacity."""
    rng = random.Random(6)
    room, pieces, groups = tokens.Room(), [], 0
    while groups < 20:
        left = rng.choice([rng.randint(2, 60), rng.randint(60, 800), rng.randint(800, 2047)])
        while left:
            size = room.take(left)
            pieces.append(size)
            left -= size
            if room.full:
                sums = [sum(pieces[k] for k in w) for w in tokens.balanced(pieces)]
                assert len(sums) == tokens.TOGETHER and max(sums) <= tokens.WINDOW and min(sums) >= 0.98 * tokens.WINDOW
                room, pieces, groups = tokens.Room(), [], groups + 1


def test_written_matrices_are_padded(docs, corpus, tmp_path):
    tokens.write_packed(docs, str(tmp_path / "packed"), pad=7)
    rows = docs.sparkSession.read.parquet(str(tmp_path / "packed")).toPandas()
    whole = tokens.pack_best_fit(docs).toPandas().set_index("sequence_id")
    for r in rows.itertuples():
        ids, want = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(whole.loc[r.sequence_id].input_ids, "<u4")
        assert len(ids) == len(r.position_ids) // 4 == tokens.WINDOW
        assert np.array_equal(ids[: r.n_tokens], want) and (ids[r.n_tokens :] == 7).all()


def test_best_fit_takes_the_tightest_window():
    assert tokens.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]


def test_words_equal_the_library():
    rng = random.Random(2)
    letters = "aA bB\n\t.,'!%’sStTéÉßñΣσςİı0123#<>|_-\"\\/“”ﬁ́ 你好क्षि😀ÀÇŒœªºµ½"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["it's DON'T <|endoftext|>x", "ΑΣ. Σ"]
    for text, ids in zip(texts, tokens.Words(tokens.default_vocabulary()).ids(texts), strict=True):
        assert ids == library(text)[:-1].tobytes(), text


def test_every_token_merges_from_its_own_letters():
    """Then merging by ranks of byte strings and by pairs is the same: within a token's letters only its own last pair can be left."""
    with open(tokens.default_vocabulary(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks = {tuple(p if isinstance(p, list) else p.split(" ")): i for i, p in enumerate(model["merges"])}
    assert len(ranks) == len({a + b for a, b in ranks})
    for token in model["vocab"]:
        if token.startswith("<|"):
            continue
        parts = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: (ranks.get((parts[i], parts[i + 1]), 1 << 30), i))
            assert (parts[at], parts[at + 1]) in ranks, token
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


# --- near-dedup


def truth(corpus, size, percent):
    sets = {}
    for i, text, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, corpus, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, size, percent).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in truth(corpus, size, percent).items()}


def test_large_regions_are_compared_in_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == truth(corpus, 3, 85)


def test_shuffled_joins_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "maybe_broadcast", lambda df, rows: df)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == truth(corpus, 3, 85)


def test_representatives_and_blocks_equal_brute_force(docs, corpus, monkeypatch):
    """Whatever representatives leave unlinked is compared in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "FIRST", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 5, 80).collect()}
    assert got == truth(corpus, 5, 80)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(1, 4))
def test_pivots_give_the_components_of_all_pairs(seed, n, kinds):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (kinds, 16), dtype=np.uint8)
    rows = base[rng.integers(0, kinds, n)] ^ (rng.integers(0, 256, (n, 16), dtype=np.uint8) & rng.integers(0, 256, (n, 16), dtype=np.uint8) & rng.integers(0, 256, (n, 16), dtype=np.uint8))
    got = neardup.connected(rows, 0.6)
    union = components.Union()
    for i in range(n):
        for j in np.flatnonzero(neardup._agree(rows[i], rows) >= 0.6):
            union.join(i, int(j))
    want = [union.root(i) for i in range(n)]
    assert len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_of_linked_sets_agree(percent):
    rng = np.random.default_rng(percent)
    lost = tried = 0
    for common, own in ((4, 1), (6, 1), (8, 2), (12, 2), (40, 7), (160, 40), (170, 30)):
        if 100 * common < percent * (common + own):
            continue
        for _ in range(400):
            found = rng.integers(0, 2**64, common + own, dtype=np.uint64)
            a, b = (neardup.sketch_bits(neardup.signature(x)) for x in (found, found[:common]))
            lost += 2 * (a == b).mean() - 1 < percent / 100 - neardup.SLACK
            tried += 1
    assert tried >= 1600 and lost <= 1


def test_crowds_are_reached(spark):
    """4,000 documents share a long template, and each of 700 has one near copy: no link is lost, and the crowd isn't one component."""
    rng = random.Random(21)
    template = prose(rng, 110, 5000)
    rows, want = [], {}
    for i in range(4000):
        own = [f"{rng.randrange(10**9):x}" for _ in range(60)]
        rows.append((i, f"{template} {' '.join(own)}"))
        if i < 700:
            own[30] = "changed"
            rows.append((10_000 + i, f"{template} {' '.join(own)}"))
            want[10_000 + i] = i
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 3, 85).collect()}
    found = sum(got[x] == got[y] for x, y in want.items())
    assert found >= 0.999 * len(want)
    assert len(set(got.values())) == len(rows) - found


def test_clashing_columns_stay(spark):
    names = ["doc_id", "text", "source", "a.b", "node", "region", "__bad", "n_dropped", "c0", "kept", "word", "n_chars"]
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(i, f"{text} {i}\nfooter", "s", *range(8), 0) for i in range(12)] + [(99, None, None, *range(8), 0)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    items = spark.createDataFrame([(1, text + " 3")], "item_id long, text string")
    for stage in (lines.stage, neardup.stage, lambda d: decontam.stage(d, items), quality.keep_good):
        out = stage(df)
        assert out.columns == names
        for r in out.collect():
            assert tuple(r)[3:11] == tuple(range(8))
    assert [r.text.split("\n")[-1] for r in lines.stage(df).filter("doc_id = 3").collect()] != ["footer"]
    for op in (tokens.pack_balanced, tokens.pack_best_fit, neardup.near_duplicates, lambda d: decontam.find(d, items)):
        assert op(df).count() > 0


def test_near_duplicates_edge_rows(spark, docs):
    long = " ".join(f"w{k}" for k in range(30))
    odd = spark.createDataFrame([(None, long), (1, long), (1, "quite other words than that here"), (2, "quite other words than that here"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.stage(docs).columns == docs.columns


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=40))
def test_components(spark, edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """A round deals all edges out a dozen times. Few edges take none, and more edges come to the same by rounds."""
    rounds, large = [], components._large
    monkeypatch.setattr(components, "_large", lambda *a: rounds.append(1) or large(*a))
    edges = [(x, x + 1) for x in range(40)] + [(100, x) for x in range(101, 130)] + [(129, 200), (7, 7), (None, 3)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    want = {x: 0 for x in range(41)} | {x: 100 for x in [*range(100, 130), 200]}
    got = lambda **more: {r.node: r.root for r in components.components(df, **more).collect()}
    assert got() == want and not rounds
    assert got(together=0) == want and rounds


# --- line dedup


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        body = [prose(rng, 6) for _ in range(4)]
        body += ["Menu | Home"] * (i % 2) + [" Menu | Home "] * (i % 5 == 0) + ["rare footer"] * (i % 30 == 0) + [""]
        rows.append((i, "\n".join(body), "en", None if i % 4 == 0 else f"host{i % 4}", 0))
    # small hosts: a footer on all of three pages, and one on two
    rows += [(400 + k, f"{prose(rng, 6)}\nsmall footer", "en", f"little{k // 3}", 0) for k in range(5)]
    rows += [(450, "\n".join(prose(rng, 6) for _ in range(5000)) + "\nMenu | Home", "en", "host1", 0)]
    rows += [(200 + k, rows[1][1], "en", "host1", 0) for k in range(50)] + [(300, None, "en", "host1", 0), (301, "", None, "host9", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pages, hits = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        if text is not None:
            pages[host].add(text)
            for line in {x.strip() for x in text.split("\n")} - {""}:
                hits[host, line].add(text)
    bad = {k for k, v in hits.items() if len(v) >= lines.LEAST_HITS and len(v) > lines.RATIO * len(pages[k[0]])}
    assert ("little0", "small footer") in bad and ("little1", "small footer") not in bad
    assert (None, "Menu | Home") in bad and not any(x == "rare footer" for _, x in bad)
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip()) not in bad) for i, t, _, h, _ in rows}
    got = {r.doc_id: r.text for r in lines.digest(df).collect()}
    assert got == want
    assert lines.stage(df).columns == df.columns
    assert lines.digest(df.limit(0)).count() == 0


# --- HTML


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<nav>Menu</nav><article><h1>T</h1><p>A <b>b</b>c &amp; d&eacute;<br>x<p>y</article><footer>F</footer>", "T A bc & dé x y"),
        ("<body><header>H</header><main><div class='ad'>Buy</div><p>Long&nbsp;text</p><div id=comments><p>first!</p></div></main><aside>s</aside>", "Long text"),
        ("<article><p>One</p><script>var t='</p><p>no';</script><form><p>f</p></form><div class=\"cookie-notice\"><div>x</div>y</div><p>Two</p>", "One Two"),
        ("<article><p>a &lt; b</p><!-- <p>hidden</p> --><p>cut <a href='x'>link</a> here</p><p", "a < b cut link here"),
        ("<ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul>" + "<p>" + "real words here and there " * 10 + "</p><p>more of it in a second block</p><ul><li><a href=3>Next</a></li></ul>", ("real words here and there " * 10).strip() + " more of it in a second block"),
        ("plain", "plain"),
        ("<title>only</title>", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


PARAGRAPHS = [" ".join(f"word{j}{k}" for j in range(30 + 10 * k)) for k in range(5)]
UNMARKED = (
    "<div class='q1'><a href=1>Home</a> <a href=2>News</a></div><div class='q2'>12 May</div><div class='q3'><h2>A title</h2>"
    + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3])
    + "<p>Short.</p><div class='ad'>Buy this now</div><div><a href=3>All offers</a></div><div class='ad'>Buy that</div><div><a href=4>More</a></div>"
    + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[3:])
    + "</div><div class='q4'><a href=5>Next</a></div><div class='q5'>Some firm 2020</div>"
)


def test_line_blocks_decide_on_unmarked_pages(monkeypatch):
    want = " ".join(["A title", *PARAGRAPHS[:3], "Short.", *PARAGRAPHS[3:]])
    assert html.main_text(UNMARKED) == want
    monkeypatch.setattr(html, "main_part", lambda weights: (0, len(weights)))
    assert html.main_text(UNMARKED) == f"12 May {want} Some firm 2020"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 5, 40, 90, 250, 400]), min_size=1, max_size=25))
def test_surge_and_dive_equal_brute_force(weights):
    windows = [(sum(weights[i : i + html.SPAN]), i) for i in range(max(1, len(weights) - html.SPAN + 1))]
    least = html.SURGE * max(windows)[0]
    if not least:
        assert html.main_part(weights) == (0, 0)
        return
    inside = {k for total, i in windows if total >= least for k in range(i, min(i + html.SPAN, len(weights)))}
    strong = [k for k in range(len(weights)) if weights[k] * html.SPAN >= least and min(inside) <= k <= max(inside)]
    assert html.main_part(weights) == (strong[0], strong[-1] + 1)


@pytest.mark.parametrize("bad", ['<b x="y" ', "<p ", "</a ", "<a x=\"", "<p 'x", "<a =", "<!-", "<svg"])
def test_hostile_pages_take_linear_time(bad):
    from time import process_time

    start = process_time()
    html.main_text(bad * 40_000)
    assert process_time() - start < 5  # about 360 kB


def test_very_long_pages_are_read_whole():
    many = [f"paragraph {k} of the page" for k in range(60_000)]
    assert html.main_text("<nav>x</nav><article>" + "".join(f"<p>{p}</p>" for p in many) + "</article>") == " ".join(many)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article>x  y</article>"), (None, None, None), (1, "u", "<article>x  y</article>")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html.extract(df).collect())
    assert got == [(0, "", "", 0), (1, "u", "x y", 3), (1, "u", "x y", 3)]
    assert html.extract(df.limit(0)).count() == 0


# --- decontamination


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, rng.choice([15, 30, 55]), 6000) + ". So the answer is " + prose(rng, 5, 6000)) for k in range(30)]
    return items, spark.createDataFrame([*items, (98, None), (99, " ")], "item_id long, text string")


def test_decontamination_finds_whole_and_changed_passages(spark, bench):
    rng = random.Random(12)
    items, table = bench
    rows, want = [], {}
    for i in range(200):
        words = prose(rng, 200, 6000).split()
        if i % 10 == 0:
            k, text = items[rng.randrange(len(items))]
            part = text.split()
            if i % 20 == 0:  # a paraphrase: every fifth word is another one
                part = [w if j % 5 else "zzz" for j, w in enumerate(part)]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() for w in part]
            want[i] = k
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(500, None, None, None, None), (501, "", None, None, None), (None, items[0][1], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontam.find(df, table).collect()}
    assert got == {*want.items(), (None, 0)}
    kept = {r.doc_id for r in decontam.stage(df, table).collect()}
    assert kept == {r[0] for r in rows} - set(want)
    assert decontam.find(df.limit(0), table).count() == decontam.find(df, table.limit(0)).count() == 0


def test_benchmark_portions_change_nothing(spark, bench, monkeypatch):
    items, table = bench
    df = spark.createDataFrame([(i, f"before {t} after", "en", "s", 0) for i, t in items], SCHEMA)
    one = {(r.doc_id, r.item_id) for r in decontam.find(df, table).collect()}
    monkeypatch.setattr(decontam, "ITEMS", 7)
    monkeypatch.setattr(decontam, "ROUND", 2)
    assert one == {(i, i) for i, _ in items} == {(r.doc_id, r.item_id) for r in decontam.find(df, table).collect()}


def test_large_benchmark_is_found_verbatim(spark):
    rng = random.Random(13)
    items = [(k, prose(rng, 30, 6000)) for k in range(1100)]
    df = spark.createDataFrame([(k, f"{prose(rng, 40, 6000)} {t} {prose(rng, 40, 6000)}", "en", "s", 0) for k, t in items], SCHEMA)
    found = {(r.doc_id, r.item_id) for r in decontam.find(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k, _ in items}


def test_long_items_are_found_whole(spark, monkeypatch):
    rng = random.Random(14)
    items = [(k, prose(rng, n, 6000)) for k, n in enumerate((70, 200, 400, 600, 1000, 1500, 5000))]
    rows = [(k, f"{prose(rng, 300 + 7 * k, 6000)} {t} {prose(rng, 300, 6000)}", "en", "s", 0) for k, t in items]
    # a changed copy: every fifth word is another one
    rows += [(100 + k, " ".join([prose(rng, 200, 6000), *(w if j % 5 else "zzz" for j, w in enumerate(t.split()))]), "en", "s", 0) for k, t in items]
    rows += [(200 + k, f"{prose(rng, 50, 6000)} {' '.join(t.split()[: len(t.split()) // 3])} {prose(rng, 3000, 6000)}", "en", "s", 0) for k, t in items]
    monkeypatch.setattr(decontam, "ITEMS", 40)  # long items take several portions
    every = [(r.doc_id, r.item_id) for r in decontam.find(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()]
    found = set(every)
    assert len(every) == len(found)
    assert found >= {(k, k) for k, _ in items} | {(100 + k, k) for k, _ in items}
    assert not {(d, i) for d, i in found if d >= 200 and len(items[i][1].split()) > 64}, "a third of an item is not the item"


def test_items_of_repeated_words_are_found(spark):
    rng = random.Random(15)
    items = [(0, "la " * 30 + "end of song"), (1, "go go stop " * 12 + "now"), (2, ("alpha beta " * 15).strip())]
    df = spark.createDataFrame([(k, f"{prose(rng, 100, 6000)} {t} {prose(rng, 100, 6000)}", "en", "s", 0) for k, t in items] + [(9, prose(rng, 300, 6000), "en", "s", 0)], SCHEMA)
    assert {(r.doc_id, r.item_id) for r in decontam.find(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(k, k) for k, _ in items}


def test_found_equals_all_pairs_by_subsequence(spark):
    """Against brute force: every document and item, by the longest common subsequence of a window as wide as the search takes."""
    rng = random.Random(16)
    items = [(k, prose(rng, rng.choice([16, 24, 40]), 6000)) for k in range(12)]
    rows = []
    for i in range(150):
        text = prose(rng, rng.randint(20, 200), 6000).split()
        if i % 3 == 0:  # some share of an item's words, in order
            part = items[rng.randrange(12)][1].split()
            keep = rng.choice([0.2, 0.3, 0.8, 0.9, 1.0])
            text[5:5] = [w for w in part if rng.random() < keep]
        rows.append((i, " ".join(text), "en", "s", 0))
    got = {(r.doc_id, r.item_id) for r in decontam.find(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    numbers = {}
    number = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in t.split()])
    share = {(i, k): decontam.subsequence(number(t), number(d)) / len(t.split()) for i, d, *_ in rows for k, t in items}
    assert {x for x, s in share.items() if s >= 0.75} <= got  # above the threshold by more than the windows' edges
    assert all(share[x] >= decontam.COVER_ANSWERED for x in got)


def test_one_pass_counts_every_word(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "B c"), (3, None), (4, "zz a")], "doc_id long, text string")
    n, counts = decontam.frequencies(df, spark.createDataFrame([(1, "a, b"), (2, None), (3, "q")], "item_id long, text string"))
    hashes = {decontam.xxhash.xxh3_64_intdigest(w): w for w in (b"a", b"b", b"c", b"q", b"zz")}
    got = {hashes[r.word % 2**64]: r.n for r in counts.collect()}
    assert n == 4 and (got["a".encode()], got[b"b"], got.get(b"q")) == (2, 2, None)


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontam.subsequence(a, b) == table[-1, -1]


def test_randomised_svd_spans_the_rows(spark):
    rng = np.random.default_rng(4)
    dense = rng.standard_normal((12, 40)) * (rng.random((12, 40)) < 0.3)
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for r in dense]
    space = decontam.randomised_svd(spark.createDataFrame(rows, "at array<int>, value array<double>"), 40, 12)
    assert np.allclose(dense @ space @ space.T, dense, atol=1e-6)


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left.count(), stage(spark, left, sf).cache()
        assert left.columns == docs.columns and 0 < left.count() <= before, name
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert packed == {r.doc_id for r in left.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    short = F.size(F.split("text", r"\s+")) < 10
    clean = docs.filter(~short).join(labels, "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.01 * clean.count()


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Null, empty, very long and repeated rows and columns of other names go through every stage; an empty table stays empty."""
    import corpus_pipeline

    rng = random.Random(31)
    some = prose(rng, 6000, 3000).split()
    sentence = lambda n: " ".join(rng.choice("the a of to and in".split()) if k % 3 == 0 else rng.choice(some) for k in range(n)).capitalize() + "."
    clean = ["\n".join(sentence(12 + k % 7) for k in range(8)) for _ in range(30)]
    long = "\n".join(sentence(14) for _ in range(4000))
    rows = [(i, t, "en", f"s{i % 3}", len(t), i) for i, t in enumerate(clean)]
    rows += [(5, clean[5], "en", "s2", 0, 5), (100, clean[7], "en", None, 0, 0), (101, long, "en", "s1", 0, 0), (102, None, None, None, None, None), (103, "", "en", "s1", 0, 0), (None, clean[9], "en", "s1", 0, 0)]
    for k, some in enumerate((rows, [])):
        at = tmp_path / str(k)
        spark.createDataFrame(some, SCHEMA + ", node long").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, clean[3].split("\n")[2] + " " + clean[3].split("\n")[3]), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, str(at)).collect()
        ids = {r.doc_id for r in packed}
        if not some:
            assert not packed
            continue
        assert 3 not in ids and 100 not in ids and not {102, 103} & ids
        assert {101, None, 5, 7} <= ids and len(ids & set(range(30))) >= 27
        for doc in ids - {5}:
            pieces = sorted((r.start, r.length, r.doc_tokens) for r in packed if r.doc_id == doc)
            assert sum(p[1] for p in pieces) == pieces[0][2] and pieces[0][0] == 0


def test_shared_folder(spark):
    path = common.cut(spark.range(3))
    assert path.count() == 3
    common.discard(path)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        path.collect()
