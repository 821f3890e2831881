"""The pipeline stage by stage against plain Python, its edge cases, and the registered queries."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from colloquy.llm import queries, quality, vocab
from colloquy.session import materialize

from .helpers import SCHEMA, edge_rows
from .test_native_operators import brute_targets
from .test_text_operators import CONTENT, WORD, brute_components, brute_measures, brute_print, lowered

SF = "/root/testdata/sf0.001"


def brute_kept(docs, labels):
    """Ids that pass the base rules and the bands, from the measures of each text."""
    fertility = quality.Fertility(vocab.byte_encoding(open(vocab.MULTI_RANKS, "rb").read()))
    good = Counter(i for i, q, _ in labels if q == 1)
    m, cells = {}, defaultdict(list)
    for i, text, lang, *_ in docs:
        one = quality.measure_text(text, fertility)
        octave = int(math.floor(math.log2(max(one[5], 1))))
        m[i] = (brute_measures(text), one[6:9], (("lang", lang, octave), ("script", one[9], octave)))
        for cell in m[i][2]:
            cells[cell] += [one[6:9]] * good[i]
    bands = {}
    for cell, rows in cells.items():
        if len(rows) >= quality.MIN_LABELLED:
            for k in range(3):
                v = sorted(round(r[k], 2) for r in rows)
                lo = next(x for n, x in enumerate(v, 1) if v.count(x) and sum(y <= x for y in v) > len(v) * quality.TAIL)
                hi = next(x for x in v if sum(y <= x for y in v) >= len(v) * (1 - quality.TAIL))
                wide = max((hi - lo) * quality.MARGIN, 0.02)
                bands[cell, k] = (lo - wide, hi + wide)
    kept = set()
    for i, (base, values, own) in m.items():
        ok = base[0] >= 10 and 100 * base[4] <= 20 * base[0]
        for k in range(3):
            band = bands.get((own[0], k), bands.get((own[1], k)))
            ok = ok and (band is None or band[0] <= values[k] <= band[1])
        if ok:
            kept.add(i)
    return kept


def brute_cut(docs, items):
    """Texts without the words of benchmark phrases; nothing left: None."""
    phrases = set()
    for _, t in items:
        w = CONTENT.findall(lowered(t))
        phrases |= {tuple(w[s:s + 10]) for s in range(max(len(w) - 9, 1) if w else 0)}
    lengths = {len(p) for p in phrases}
    out = {}
    for i, t in docs:
        places = [m.span() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
        w = [lowered(t[a:b]) for a, b in places]
        hit = {j for n in lengths for s in range(len(w) - n + 1) if tuple(w[s:s + n]) in phrases for j in range(s, s + n)}
        if w and len(hit) == len(w):
            continue
        text, at = "", 0
        for j in sorted(hit):
            if j - 1 not in hit:
                text += t[at:places[j][0]]
            at = places[j][1]
        out[i] = t if not hit else text + t[at:]
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select(*SCHEMA.names).collect()]
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    one = materialize(stages["quality"](spark, docs, SF))
    assert one.columns == columns
    kept = brute_kept(rows, labels)
    assert {r.doc_id for r in one.collect()} == kept and one.count() == len(kept)

    two = materialize(stages["near_duplicates"](spark, one, SF))
    assert two.columns == columns
    prints = {i: brute_print(t) for i, t, *_ in rows if i in kept}
    comp = brute_components(sorted(set(prints.values())), 2)
    first = {}
    for i in sorted(prints):
        first.setdefault(comp[prints[i]], i)
    assert Counter(r.doc_id for r in two.collect()) == Counter(first.values())

    three = materialize(stages["decontamination"](spark, two, SF))
    assert three.columns == columns
    texts = {i: t for i, t, *_ in rows if i in set(first.values())}
    cut = brute_cut(texts.items(), items)
    got = {r.doc_id: r for r in three.collect()}
    assert {i: r.text for i, r in got.items()} == cut and any(cut[i] != texts[i] for i in cut)
    assert all(r.n_chars == len(r.text) for r in got.values())

    four = materialize(stages["mixing"](spark, three, SF))
    assert four.columns == columns
    mixed = four.collect()
    times = Counter(r.doc_id for r in mixed)
    assert all(tuple(r) == tuple(got[r.doc_id]) for r in mixed) and max(times.values()) <= 3
    sizes, members = Counter(), Counter()
    for r in got.values():
        sizes[r.source] += len(WORD.findall(r.text))
        members[r.source] += 1
    for source, target in brute_targets(sizes).items():
        want = members[source] * target / sizes[source]
        assert abs(sum(n for i, n in times.items() if got[i].source == source) - want) < 1 + 1e-6

    five = stages["sharding"](spark, four, SF).collect()
    assert Counter(tuple(r)[:len(columns)] for r in five) == Counter(map(tuple, mixed))
    slots = defaultdict(list)
    for r in five:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1

    # the whole run gives the same rows as the stages one after another
    run = cp.run(spark, SF)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, five))


@pytest.mark.parametrize("rows", [edge_rows(), []])
def test_run_on_edge_tables(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit("x"), "size": F.lit(1), "rec": F.lit(2.0)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1, 0), (None, 1, None), (20, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (None, "one two")], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == SCHEMA.names + ["size", "rec", "shard", "slot"]
    got = out.collect()
    base = {i for i, t, *_ in rows if brute_measures(t)[0] >= 10 and 5 * brute_measures(t)[4] <= brute_measures(t)[0]}
    assert {r.doc_id for r in got} <= base and bool(got) == bool(rows)


def test_every_query_reads_whole_tables(spark):
    n_docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    n_pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11))
    for name in ("op1_language_id", "op4_html_extraction", "op7_quality"):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == (n_pages if "html" in name else n_docs)
    hist = queries.QUERIES["op6_token_counts"](spark, SF).collect()
    assert sum(r.n_docs for r in hist) == n_docs


def test_contract_columns(spark):
    want = {"op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
            "op2_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            "op4_html_extraction": ["page_id", "url", "text", "n_chars"],
            "op5_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            "op7_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                            "kept"],
            "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
            "op9_simhash": ["doc_id", "fingerprint", "component_id"],
            "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]}
    kinds = {"doc_id": "bigint", "page_id": "bigint", "held_out": "boolean", "score": "double", "lang_pred": "string",
             "contaminated": "boolean", "items_sha256": "string", "base_failed": "boolean", "kept": "boolean",
             "target": "double", "fingerprint": "string", "law": "string", "shard": "int", "grown_shard": "int",
             "base_score": "double", "url": "string", "text": "string"}
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, SF)
        assert got.columns[:len(columns)] == columns
        assert all(kind == kinds.get(c, "bigint") for c, kind in got.dtypes[:len(columns)])
