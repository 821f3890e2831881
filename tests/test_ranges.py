"""Large JSON lists and CSV files read in byte ranges, against whole-file readers."""

import csv
import json
import random

import pytest
from pyspark.sql import types as T

from colloquy.session import scratch_path
from colloquy.sources import io
from colloquy.sources import ranges as R

BITS = ["a", "{", "}", "[", "]", '"', "\\", "\n", "漢", "é", "😀", " ", ",", ":", '\\"', "}}", '"}]', "\\u00e9"]


def documents(rng, dialogues):
    def text():
        return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25)))

    def turn():
        extra = {"meta": {"x": [1, {"y": text()}], "z": [], text(): [[]]}} if rng.random() < 0.3 else {}
        return {"speaker": rng.choice(["patient", "doctor", None]), "content": text(), **extra}
    return [[turn() for _ in range(rng.choice([0, 1, 2, 5]))] for _ in range(dialogues)]


@pytest.mark.parametrize("range_bytes", [61, 1000, None])
def test_json_list_in_ranges_is_the_whole_list(spark, tmp_path, range_bytes):
    """Ranges of 61 bytes end inside strings, escapes, nested values and characters of several bytes."""
    doc = documents(random.Random(3), 20)
    styles = {"a": dict(ensure_ascii=False, indent=1), "b": dict(ensure_ascii=True), "c": dict(separators=(",", ":"))}
    for name, style in styles.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, **style), encoding="utf-8")
    (tmp_path / "d.json").write_text(" [ ]\n")
    (tmp_path / "e.json").write_text("")
    got = [(r.file[-6], r.conv, r.turn, json.loads(r.body)) for r in
           R.read_json_turns(spark, str(tmp_path), range_bytes).collect()]
    want = [(n, i, j, t) for n in styles for i, c in enumerate(doc) for j, t in enumerate(c)]
    assert sorted(got, key=lambda r: r[:3]) == want


def test_no_task_reads_the_file_whole(spark, tmp_path):
    from pyspark.sql import functions as F
    (tmp_path / "a.json").write_text(json.dumps(documents(random.Random(4), 200)))
    own = R.ranged_session(spark, 2000)
    chunks = R._chunks(own, str(tmp_path), "}")
    size = (tmp_path / "a.json").stat().st_size
    read = chunks.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("value")).alias("n")).collect()
    assert len(read) >= size // 4000 and max(r.n for r in read) < 6000


@pytest.mark.parametrize("text", ['[[{"a": "b"}]', '[[{"a": "b}]]', '{"a": [1]', '[[{"a": 1}]]]'])
def test_a_list_that_does_not_close_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="a.json"):
        R.read_json_turns(spark, str(tmp_path), 5)


def test_other_fields_of_a_turn(spark, tmp_path):
    (tmp_path / "a.json").write_text('[[{"speaker": "p", "content": "x", "tags": ["u", "v"], "more": 1}],'
                                     '[{"content": "y"}, {"tags": null, "speaker": "d"}]]')
    fields = T.StructType([*io.TURN.fields, T.StructField("tags", T.ArrayType(T.StringType()))])
    rows = io.read_dialogues(spark, str(tmp_path), whole_document=True, fields=fields, file_col="path").collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text, r.tags) for r in rows) == [
        (0, 0, "p", "x", ["u", "v"]), (1, 0, None, "y", None), (1, 1, "d", None, None)]
    assert all(r.path.endswith("a.json") for r in rows)


def test_documents_written_and_read_back(spark):
    rows = [(c, t, "user", f"x{c} \"{t}\" }}", c * 2) for c in range(30) for t in range(1 + c % 4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, twice long")
    path = scratch_path(spark, "test-documents")
    io.write_dialogue_documents(turns, path, files=3, extra=["twice"])
    fields = T.StructType([*io.TURN.fields, T.StructField("twice", T.LongType())])
    back = io.read_dialogues(spark, path, whole_document=True, fields=fields, range_bytes=200).collect()
    assert sorted((r.twice // 2, r.turn, r.role, r.text, r.twice) for r in back) == rows


# ---------------------------------------------------------------------- CSV
CELLS = ["", "a", "b c", 'q"x"', "l1\nl2", ",", "\n", '"', '5" tall', "漢\né", '""', 'x\ny,"z"\n\n', " lead", "\\N"]


@pytest.mark.parametrize("range_bytes", [61, 700, None])
def test_csv_in_ranges_is_what_the_built_in_reader_reads(spark, tmp_path, range_bytes):
    rng = random.Random(6)
    for name, end in (("a", "\n"), ("b", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as h:
            out = csv.writer(h, lineterminator=end)
            out.writerow(["question", "A", "B\nb", "C", "D", "answer"])
            for i in range(60):
                out.writerow([f"{i}" + rng.choice(CELLS)] + [rng.choice(CELLS) for _ in range(rng.choice([5, 5, 5, 4, 6]))])
            h.write(end)
            h.write(f'plain 5" x,"quoted, 6"" x",,,,A{end}last,"open to the end' if name == "a" else "last,1,2,3,4,5")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "A", "B", "C", "D", "answer")])
    want = sorted(str(tuple(r)) for r in io.csv_reader(spark).schema(schema).csv(str(tmp_path)).collect())
    got = sorted(str(tuple(r)) for r in io.read_exam_csv(spark, str(tmp_path), range_bytes=range_bytes).collect())
    assert got == want


def test_state_of_a_line():
    for line, out, inside in [("a,b", False, True), ('a,"b', True, False), ('"a ""x"",', True, False), ('""', False, True),
                              ('"""', True, False), ('5" tall', False, False), ('x,5" tall,"y', True, True),
                              ('a",b,"c', True, True), ("", False, True), ('",', False, False)]:
        if line == '",':  # opens a cell when outside, closes one when inside
            assert R.line_state(line.encode(), False) and not R.line_state(line.encode(), True)
            continue
        assert R.line_state(line.encode(), False) == out, line
        assert R.line_state(line.encode(), True) == inside, line
