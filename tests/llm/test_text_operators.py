"""SimHash, decontamination, quality, LM scoring, language ID, token counts and HTML against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import (decontam, fm_index, html_text, langid, lm, quality, simhash, token_counts, vocab)
from colloquy.llm.queries import crc_rest

from .helpers import SCHEMA, edge_rows, edges, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------------ simhash
def brute_print(text):
    import xxhash

    w = WORD.findall(lowered(text))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_pigeonring_finds_every_link(spark, bits):
    rng = random.Random(bits)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):  # chains of neighbours at every distance up to one beyond the limit
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, bits + 1)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    rows = simhash.connected_components(simhash.fingerprint_links(df, bits)).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.root].add(r.node)
    want = defaultdict(set)
    for p, root in brute_components(prints, bits).items():
        want[root].add(signed(p))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_bucket_links_are_fewer_than_members():
    members = np.array([signed(1 << b) for b in range(16)] + [0], "<i8")
    links = simhash._bucket_links(2 * 8, members, 2)
    assert len(links) == 16


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1002), (1001, 1002)], "u bigint, v bigint")
    rows = simhash.connected_components(links).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_simhash_groups_edges(spark):
    rows = edge_rows()
    got = simhash.simhash_groups(edges(spark, clashing=True)).collect()
    assert len(got) == len(rows)
    prints = {t: brute_print(t) for _, t, *_ in rows}
    comp = brute_components(sorted(set(prints.values())), 2)
    least = {}
    for i, t, *_ in rows:
        c = comp[prints[t]]
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    want = Counter((i, f"{prints[t]:016x}", least[comp[prints[t]]]) for i, t, *_ in rows)
    assert Counter((r.id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.drop_near_duplicates(edges(spark, clashing=True))
    assert kept.columns == edges(spark, clashing=True).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values())
    assert simhash.simhash_groups(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0


# ---------------------------------------------------------- decontamination
def test_fm_index_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(10):
        parts = [np.append(rng.integers(1, rng.integers(2, 8), rng.integers(0, 60)), 0) for _ in range(rng.integers(1, 25))]
        text = np.concatenate(parts + parts[:4]).astype("<i4")
        order = fm_index.suffix_order(text)
        assert sorted(order.tolist()) == list(range(len(text)))
        fm = fm_index.FMIndex.of(fm_index.FMIndex.build(text, 9).arrays())
        phrases, lengths = rng.integers(1, 7, (40, 4)), rng.integers(0, 5, 40)
        lo, hi = fm.search(phrases, lengths)
        for k in range(40):
            p = phrases[k, :lengths[k]].tolist()
            want = [i for i in range(len(text) - len(p) + 1) if p and text[i:i + len(p)].tolist() == p]
            assert sorted(fm.locate(np.arange(lo[k], hi[k])).tolist()) == want


CONTENT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    phrases = defaultdict(set)
    for i, t in items:
        w = CONTENT.findall(lowered(t))
        for s in range(max(len(w) - 9, 1) if w else 0):
            phrases[tuple(w[s:s + 10])].add("null" if i is None else str(i))
    lengths = {len(p) for p in phrases}
    out = []
    for i, t in docs:
        w = CONTENT.findall(lowered(t))
        hit, ids = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in phrases:
                    hit.update(range(s, s + n))
                    ids |= phrases[tuple(w[s:s + n])]
        out.append((i, len(w), len(hit), tuple(sorted(ids))))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"shard_words": 50, "piece_words": 16, "block": 7}])
def test_decontamination_against_brute_force(spark, options):
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(6)] + ["Ça", "x-y", "A"]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 9, 10, 14])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "--"), (None, items[0][1]), (103, items[1][1]), (103, "w1 w2 w3")]
    docs = edge_rows()
    docs = [(i, t) for i, t, *_ in docs] + [(200 + k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 90))))
                                            for k in range(40)]
    docs += [(300 + k, f"before {items[k % 25][1]} after") for k in range(30)] + [(300, f"before {items[0][1]} after")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, spans int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(df, bench, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got) == brute_hits(docs, items)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r.spans or []) == r.n_hit
        assert all(a["stop"] < b["start"] for a, b in zip(r.spans or [], (r.spans or [])[1:]))


def test_decontaminate_cuts_spans(spark):
    item = "Alpha beta gamma delta, epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"keep this. {item}! and this", 0), (2, item, 0), (3, "clean  text stays\nas is", 23), (4, None, None),
            (5, "", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.decontaminate(df, bench).collect()}
    assert got == {1: ("keep this. ! and this", 21), 3: docs[2][1:], 4: docs[3][1:], 5: ("", 0)}
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.decontaminate(df, nothing).count() == 5
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.decontaminate(edges(spark, clashing=True), bench).columns == edges(spark, clashing=True).columns


# ------------------------------------------------------------------ quality
def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    fertility = quality.Fertility(vocab.byte_encoding(open(vocab.MULTI_RANKS, "rb").read()))
    rng = random.Random(6)
    texts = [t for _, t, *_ in edge_rows()] + [" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 60, 3)]
    texts += ["same line\nsame line\n \nother | line\n#$", "emoji \U0001F600\U0001F9FF ಠ"]
    for t in texts:
        m = quality.measure_text(t, fertility)
        assert m[:5] == brute_measures(t)
        ids = fertility.encoding.encode_ordinary(t or "")
        counts = np.array(list(Counter(ids).values())) / max(len(ids), 1)
        assert m[5] == len(ids) and m[8] == pytest.approx(float(-(counts * np.log2(counts)).sum()) if ids else 0.0)
        assert m[7] == pytest.approx(
            sum("\ufffd" in fertility.encoding.decode([i]) for i in ids) / len(ids) if ids else 0.0)
    assert [quality.script_of(t) for t in ("abc", "12 !", "кириллица 12", "漢字 漢", "한글", "née")] == [
        "latin", "none", "cyrillic", "han", "hangul", "latin"]


def test_quality_verdicts(spark):
    rng = random.Random(7)
    good = [(i, " ".join(rng.choice("tree stone river light wind rain sun moon".split()) + rng.choice(["", "s", "ed", "ing", "er"])
                         for _ in range(60)), "en", "a", 0) for i in range(200)]
    junk = [(1000 + k, " ".join("".join(rng.choice("bcdfghjkqvwxz") for _ in range(3)) for _ in range(30)), "en", "a", 0)
            for k in range(2)]
    df = spark.createDataFrame(good + junk, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(1000, 0), (None, 1), (5000, 1), (3, None)],
                                   "doc_id bigint, quality int")
    got = {r.rec.doc_id: r for r in quality.judge(df, labels).collect()}
    assert not got[1000].kept and not got[1001].kept and not got[1000].base_failed
    assert sum(got[i].kept for i in range(200)) >= 195 and all(got[i].kept for i in range(150))
    # no labels: the base rules alone decide
    bare = quality.judge(df, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in bare) and len(bare) == 202
    own = quality.judge(edges(spark, clashing=True), labels).collect()
    assert len(own) == len(edge_rows()) and all(r.base_failed and not r.kept for r in own if not (r.rec.text or "").strip())
    assert quality.judge(empty(spark), labels).count() == 0


def test_quality_thin_cells_borrow(spark):
    rng = random.Random(8)
    stems, ends = "tree stone river light wind rain sun moon".split(), ["", "s", "ed", "ing", "er"]

    def prose(n):
        return " ".join(rng.choice(stems) + rng.choice(ends) for _ in range(n))

    def junk(n):
        return " ".join("".join(rng.choice("bcdfghjkqvwxz#$|") for _ in range(4)) for _ in range(n))
    good = [(i, prose(n), "en", "a", 0) for i, n in enumerate([40] * 30 + [80] * 60 + [160] * 60)]  # no octave has 100 rows
    new = {200: (prose(20), "en"), 201: (prose(1500), "en"), 202: (prose(100), "de"), 203: (prose(100), None),
           204: ("слово дерево камень река свет ветер дождь солнце луна поле", "ru"), 205: ("река поле " * 4 + "дом лес", "uk")}
    bad = {300: (junk(20), "en"), 301: (junk(60), "en"), 302: (junk(6000), "en"), 303: (junk(60), "de"), 304: (junk(60), None),
           305: (" ".join(str(rng.randint(10**6, 10**7)) + "#$|" for _ in range(400)).replace("1", "&"), "en")}
    rows = good + [(i, t, g, "a", 0) for i, (t, g) in {**new, **bad}.items()]
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id bigint, quality int")
    got = {r.rec.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    base = {i for i, r in got.items() if r.base_failed}
    assert quality.script_of(bad[305][0]) == "none" and not base & (set(bad) | {*range(150)})
    assert {i for i in bad if got[i].kept} == set()
    assert {i for i in (*range(150), *new) if not got[i].kept} == base
    # a script with a few good labels is held against them and all others
    cyrillic = spark.createDataFrame([(204, 1)], "doc_id bigint, quality int")
    few = {r.rec.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), labels.union(cyrillic)).collect()}
    assert few[204].kept and not any(few[i].kept for i in bad)


# --------------------------------------------------------------- LM scoring
def brute_scores(rows, order, lam):
    texts = [(i, WORD.findall(lowered(t)) + ["\n"]) for i, t in rows]
    trains = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    count = Counter()
    for (_, t), train in zip(texts, trains):
        if train:
            s = ["^"] + t
            for k in range(1, order + 1):
                count.update(tuple(s[j - k + 1:j + 1]) for j in range(k - 1, len(s)))
    n = sum(c for g, c in count.items() if len(g) == 1 and g != ("^",))
    v = sum(1 for g in count if len(g) == 1 and g != ("^",))

    def p(g):
        if len(g) == 1:
            return (count[g] + 1) / (n + v + 1)
        return lam * count[g] / count[g[:-1]] + (1 - lam) * p(g[1:]) if count[g[:-1]] else p(g[1:])
    out = []
    for (i, t), train in zip(texts, trains):
        s = ["^"] + t
        out.append((i, not train, len(t), sum(count[(w,)] > 0 for w in t), n,
                    sum(math.log10((count[(w,)] + 1) / (n + v + 1)) for w in t),
                    sum(math.log10(p(tuple(s[max(0, j - order + 1):j + 1]))) for j in range(1, len(s)))))
    return out


def key(row):
    return tuple((x is None, round(x, 4) if isinstance(x, float) else x or 0) for x in row)


@pytest.mark.parametrize("options", [{}, {"order": 3, "block_tokens": 60, "range_tokens": 200}, {"order": 1}])
def test_lm_scores_against_brute_force(spark, options):
    rows = [(i, t if i != 6 else "\n".join((t or "").split("\n")[:20])) for i, t, *_ in edge_rows()]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, block string")
    got = lm.score_texts(df, F.coalesce(crc_rest("doc_id", 7) != 2, F.lit(True)), **options).collect()
    want = brute_scores(rows, options.get("order", lm.ORDER), lm.LAMBDA)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_lm_edges(spark):
    train = F.lit(True)
    assert lm.score_texts(empty(spark), train).count() == 0
    none = lm.score_texts(edges(spark), F.lit(None).cast("boolean")).collect()
    assert {(r.train_tokens, r.base_score, r.score, r.n_known, r.held_out) for r in none} == {(0, 0.0, 0.0, 0, True)}
    values = np.array([0, 1, 2**40, 2**63 - 1], "<i8")
    assert lm.restored(lm.squeezed(values), "<i8").tolist() == values.tolist()


# -------------------------------------------------------------- language ID
def test_language_id(spark):
    rng = random.Random(8)
    langs = {"en": "the of and tree stone river water light when this".split(),
             "de": "der die und baum stein fluss wasser licht wenn dies".split(),
             "ru": "и река вода свет когда этот дерево камень".split()}
    rows = []
    for i in range(300):
        lang = rng.choice(list(langs))
        rows.append((i, " ".join(rng.choice(langs[lang]) + rng.choice(["", "", "n", "s"]) for _ in range(rng.randint(3, 40))),
                     lang, "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "12 .. --", "de", "s", 0), (1002, "", None, None, None),
             (1003, "Stone, RIVER!", None, None, None), (1004, "§§ 一", "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predict(df, model).alias("p")).collect()}
    held = [(i, g) for i, _, g, *_ in rows[:300] if i % 3 == 1]
    assert sum(got[i].lang_pred == g for i, g in held) >= 0.97 * len(held)
    assert all(0 <= p.score <= 1 for p in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1003].lang_pred == "en"
    assert got[1004].lang_pred in langs
    # an unseen word is scored by its longest known n-grams, a word without any by none
    known = max(model.tables[0], key=len)
    assert model.rows_of(known) == [model.tables[0][known]]
    rows_ = model.rows_of("wasserlicht")
    assert rows_ and set(rows_) <= set(model.tables[langid.MAX_GRAM].values())
    assert model.rows_of("ሰላም") == [] or set(model.rows_of("ሰላም")) <= set(model.tables[1].values())
    none = langid.fit(empty(spark), F.lit(True))
    assert none.predict("any text") == ("und", 0.0)
    small = langid.fit(df, F.lit(True), max_entries=60)
    assert sum(map(len, small.tables)) <= 60
    assert edges(spark, clashing=True).select(langid.predict(edges(spark, clashing=True), model)).count() == len(edge_rows())


# ------------------------------------------------------------- token counts
def test_token_counts(spark):
    encoding = vocab.byte_encoding(open(vocab.BYTE_RANKS, "rb").read())
    rows = edge_rows() + [(900, "<|endoftext|> is text", "en", "a", 0)]
    lengths = sorted(len(encoding.encode_ordinary(t)) if t else 0 for _, t, *_ in rows)
    hist = token_counts.length_histogram(spark.createDataFrame(rows, SCHEMA))
    sums = token_counts.suffix_sums(hist).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == dict(Counter(lengths))
    for k, r in got.items():
        assert r.docs_from == sum(x >= k for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= k)
        assert r.truncated_tokens == sum(min(x, k) for x in lengths) and r.docs_upto == sum(x <= k for x in lengths)
    limits = [0, 1, 7, 50, 10**9]
    assert {(r.context_limit, r.docs_over, r.total_tokens) for r in token_counts.truncated_totals(sums, limits).collect()} == {
        (k, sum(x > k for x in lengths), sum(min(x, k) for x in lengths)) for k in limits}
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = {s: lengths[max(0, math.ceil(s * len(lengths)) - 1)] for s in shares}
    assert {r.share: r.n_tokens for r in token_counts.quantiles(sums, shares).collect()} == want
    assert token_counts.suffix_sums(token_counts.length_histogram(empty(spark))).count() == 0


# ---------------------------------------------------------- HTML extraction
ARTICLE = ["A river runs, slowly, through the old town, past mills & houses.",
           "In spring, the water rises; people watch it, worried, from the bridge.", "It always falls again."]


def page(before="", after="", inside="", wrap="article"):
    body = "".join(f"<p>{p.replace('&', '&amp;')}</p>\n{inside}" for p in ARTICLE)
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}<{wrap}>{body}</{wrap.split()[0]}>{after}</body></html>"


@pytest.mark.parametrize("before, after, inside", [
    ("<nav><ul><li><a href='/'>Home</a></li></ul></nav><header>Site name, slogan</header>", "<footer>&copy; 2020</footer>", ""),
    ('<div class="cookie-notice">We use cookies, sorry.</div>', '<div id="comments"><p>Nice, very nice, post!</p></div>', ""),
    ('<aside>Side, bar.</aside><div class="sideBar">x</div>', '<section class="related-posts"><p>More, more.</p></section>', ""),
    ("<script>var t='</p><p>no</p>';</script>", "<form><label>Mail</label><input></form>", '<div class="ad">Buy, now!</div>'),
    ("<!-- <p>no</p> --><noscript><p>no</p></noscript>", '<div role="complementary">no</div><div hidden>no</div>', ""),
    ('<p class="notice">Read, this.</p>', '<article class="comment"><p>I agree, fully, with all.</p></article>', ""),
    ("", "", "<ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul>")])
@pytest.mark.parametrize("wrap", ["article", "div", 'div class="post has-sidebar no-comments"'])
def test_html_keeps_the_article(before, after, inside, wrap):
    assert html_text.main_text(page(before, after, inside, wrap)) == "\n".join(ARTICLE)


@pytest.mark.parametrize("wrap, part", [("div", "div"), ("main", "section"), ("section", "div"), ("div class=content", "section")])
def test_html_keeps_articles_spread_over_siblings(wrap, part):
    long = "Water, stone, and wind shape the valley below the town. " * 60
    texts = ["A short heading", long.strip(), "Text between", "In short, it changes, slowly", "Part two", ARTICLE[0], "The end"]
    links = "".join(f"<a href='/{i}'>Read about number {i}</a> " for i in range(2))
    body = (f"<h2>{texts[0]}</h2><{part}><p>{texts[1]}</p></{part}>{texts[2]}<{part}><p>{texts[3]}</p></{part}><h3>{texts[4]}</h3>"
            f"<{part}><div><p>{texts[5].replace('&', '&amp;')}</p></div></{part}><{part}>{links}</{part}><p>{texts[6]}</p>")
    source = f"<html><body><nav>Home, sweet</nav><{wrap}>{body}</{wrap.split()[0]}><footer>Foot, er</footer></body></html>"
    assert html_text.main_text(source).split("\n") == texts
    # the page of the review: the second block scores below the bar of a fifth of the best one
    five = "word, " * 50 + "w" * 4700
    two = "text, of, " + "v" * 190
    assert html_text.main_text(f"<div><div><p>{five}</p></div><div><p>{two}</p></div></div>").split("\n") == [five, two]


def test_html_blocks_and_references(spark):
    cases = {None: "", "": "", "plain  text": "plain text", "<p>a<p>b": "a\nb", "<p>unclosed <b>x <i>y": "unclosed x y",
             "&lt;p&gt; &#x41;&amp;amp;\n z": "<p> A&amp; z", "<div><script>no": "", "<p>a<br>b</p>": "a b",
             "<div " * 50: "", "<p>x</p><p": "x", "<a href='x>y'>t</a>": "t"}
    df = spark.createDataFrame(list(enumerate(cases)), "page_id int, html string")
    got = {r.html: r.text for r in df.select("html", html_text.main_text_column(F.col("html")).alias("text")).collect()}
    assert got == cases
    deep = "<div>" * 5000 + "text, here" + "</div>" * 5000
    assert html_text.main_text(deep) == "text, here"
    long = "<p>" + "word, " * 100_000 + "</p>"
    assert html_text.main_text(long) == ("word, " * 100_000).strip()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.mark.parametrize("attributes", ['title="a hidden gem"', 'data-note="see id=ad here"', "title='class=sidebar hidden'",
                                        'alt="role=navigation" data-x', "data-hidden", 'data-role="banner"', 'title="it\'s hidden"'])
def test_html_reads_names_of_attributes_only(attributes):
    body = "".join(f"<p {attributes}>{p.replace('&', '&amp;')}</p>" for p in ARTICLE)
    assert html_text.main_text(f"<div>{body}</div>") == "\n".join(ARTICLE)


@pytest.mark.parametrize("attributes", ["hidden", 'class="x" hidden', "id=sidebar", 'title="x" CLASS = "advert"', 'x="1"hidden=""',
                                        "aria-hidden='true'", "role=navigation"])
def test_html_still_drops_by_attributes(attributes):
    body = "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in ARTICLE)
    assert html_text.main_text(f"<div>{body}<div {attributes}>Gone, of course.</div></div>") == "\n".join(ARTICLE)


def test_html_climbs_above_the_best_container():
    a, b, c = ("The valley, in short, is wide. " * 20).strip(), ("Rain, wind, and snow shape it. " * 20).strip(), "A line"
    rows = f"<div><div class=row><div>{a}</div></div><div class=row><div>{b}</div></div></div>"
    assert html_text.main_text(rows) == f"{a}\n{b}"
    deep = f"<div><div><div><p>{a}</p></div></div>{c}<section><div><div><p>{b}</p></div></div></section></div>"
    assert html_text.main_text(f"<body>{deep}</body>") == f"{a}\n{c}\n{b}"


def test_html_scores_decide_beside_a_deeper_container(monkeypatch):
    """Parts beside an ancestor stay if one scores like article text, and go if none does."""
    a, b = ("The valley, in short, is wide. " * 40).strip(), ("Rain, wind, and snow shape it. " * 30).strip()
    strong = f"<div><div><div><div>{a}</div></div></div><div><div>{b}</div></div></div>"
    weak = f"<div><div><div><div>{a}</div></div></div><div><div>Read on</div></div></div>"
    assert html_text.main_text(strong) == f"{a}\n{b}" and html_text.main_text(weak) == a
    monkeypatch.setattr(html_text.Node, "score", lambda self: 0.0)
    assert html_text.main_text(strong) != f"{a}\n{b}"


def test_langid_letters_are_letters(spark):
    assert langid.words_of("½ ²³ Ⅷ ١٢ 12_x") == ["x"] and langid.words_of("Ab½cd Éa 漢字") == ["ab", "cd", "éa", "漢字"]
    df = spark.createDataFrame([(i, "the river and the stone", "en", {"a": 1}) for i in range(20)] + [(99, "½ Ⅷ", "en", None)],
                               "doc_id long, text string, lang string, extra map<string,int>")
    model = langid.fit(df, F.lit(True))
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predict(df, model).alias("p")).collect()}
    assert got[99] == ("und", 0.0) and got[3].lang_pred == "en"
