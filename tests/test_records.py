"""Records over several lines: cut at any place, they come out the same; what is none is rejected line by line."""

import csv
import io
import random

import numpy as np
import pytest
from helpers import PAY_DATE

from shiftledger.config.systems import SourceSystem
from shiftledger.sources import records
from shiftledger.sources.exports import (
    RejectedLines,
    UnrecognizedSystem,
    header_depth,
    parse_records,
    read_lines,
    read_waiver_lists,
)

LIST = SourceSystem("List", 2, ("ID", "Note"))
SPLITS = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]


def write(root, text, client="c1", name="list.csv"):
    folder = root / f"client_id={client}" / f"pay_date={PAY_DATE}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, newline="")


def read(spark, root, split=None):
    """Rows and rejected lines; only the files are cut small, not what is kept of them."""
    for name, value in zip(SPLITS, (split, "1") if split else ()):
        spark.conf.set(name, value)
    try:
        found = records.Records(read_lines(spark, str(root)), header_depth([LIST]))
    finally:
        for name in SPLITS:
            spark.conf.unset(name)
    intake = parse_records(found, [LIST])
    rows = [(r["client_id"], r["ID"], r["Note"]) for r in intake.frames["List"].orderBy("client_id", "seq").collect()]
    bad = [(r["value"], r["reason"]) for r in intake.rejected.orderBy("client_id", "seq").collect()]
    return rows, bad


def cell(text):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow([text])
    return out.getvalue()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_every_split_size_gives_the_rows_of_a_csv_reader(spark, tmp_path, ending):
    draw = random.Random(4)
    words = ["x", "long words here", "a,b", 'say "hi"', "\n", "\n\n", ", ", '"', "é", " "]
    wanted = []
    lines = ["title", cell("two\nlines"), "ID,Note"]
    for n in range(120):
        note = "".join(draw.choice(words) for _ in range(draw.randint(0, 6))).strip(' "') + "."
        wanted.append(("c1", str(n), note))
        lines.append(f"{n},{cell(note)}" if set(note) & set(',"\n') or n % 3 else f"{n},{note}")
    write(tmp_path, "\n".join(lines).replace("\n", ending) + ending)
    whole = read(spark, tmp_path)
    assert whole == (wanted, [])
    for split in ("200", "777"):
        assert read(spark, tmp_path, split) == whole, split


def test_open_quotes_cost_no_other_line(spark, tmp_path):
    lines = ["t", "u", "ID,Note", "1,a", '2,"open', "3,b", '4,"whole, cell"', '5,"over', 'lines"', "6,c", '7,"never ends', "8,d"]
    write(tmp_path, "\n".join(lines) + "\n")
    rows = [("c1", "1", "a"), ("c1", "3", "b"), ("c1", "4", "whole, cell"), ("c1", "5", "over\nlines"), ("c1", "6", "c"), ("c1", "8", "d")]
    bad = [('2,"open', "open quote"), ('7,"never ends', "open quote")]
    for split in (None, "9", "20"):
        assert read(spark, tmp_path, split) == (rows, bad), split


def test_too_long_records_are_no_records(spark, tmp_path, monkeypatch):
    lines = ["t", "u", "ID,Note", '1,"a', *["text"] * 10, 'end"', "2,b"]
    write(tmp_path, "\n".join(lines) + "\n")
    assert read(spark, tmp_path)[0][0] == ("c1", "1", "a\n" + "text\n" * 10 + "end")
    monkeypatch.setattr(records, "RECORD_CHARACTERS", 40)
    rows, bad = read(spark, tmp_path)
    assert rows[-1] == ("c1", "2", "b") and [b[0] for b in bad] == ['1,"a', 'end"']
    assert [r[1] for r in rows[:-1]] == ["text"] * 10


def test_states_do_not_cross_files(spark, tmp_path):
    write(tmp_path, 't\nu\nID,Note\n1,"open\n', "c1")
    write(tmp_path, "t\nu\nID,Note\n2,b\n", "c2")
    assert read(spark, tmp_path) == ([("c2", "2", "b")], [('1,"open', "open quote")])


def brute(marks):
    """State by state: what each line is part of when a split starts outside or inside a cell."""
    out = []
    for state in (records._NONE, records._BEFORE):
        kinds, heads = [], []
        for i, m in enumerate(marks):
            does = m >> 1
            if state != records._NONE and does == records._BREAKS:
                state = records._NONE
            if state == records._NONE:
                kinds.append(records._HEAD if m & 1 else records._OWN)
                heads.append(i if m & 1 else records._NONE)
                state = i if m & 1 else records._NONE
            else:
                kinds.append({records._STAYS: records._TEXT, records._ENDS: records._END}.get(does, records._AGAIN))
                heads.append(state)
                state = records._NONE if does == records._ENDS else state
        out.append((kinds, heads, state))
    return out


def test_the_walk_against_one_step_a_line():
    draw = np.random.default_rng(1)
    for _ in range(300):
        marks = draw.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7], draw.integers(1, 12)).astype(np.int32)
        rows = np.arange(len(marks))
        for start, (kinds, heads, state) in zip((records._NONE, records._BEFORE), brute(marks.tolist())):
            got = records._advance(marks, rows, start)
            assert (got[0].tolist(), got[1].tolist(), got[2]) == (kinds, heads, state)
            # In two batches it is the same.
            cut = int(draw.integers(0, len(marks) + 1))
            a = records._advance(marks[:cut], rows[:cut], start)
            b = records._advance(marks[cut:], rows[cut:], a[2])
            assert np.concatenate([a[0], b[0]]).tolist() == kinds and b[2] == state


def test_the_header_search_reads_marked_lines_only(spark, tmp_path, monkeypatch):
    # Lines of a split that might start inside a cell count as well, up to the length of records.
    monkeypatch.setattr(records, "RECORD_CHARACTERS", 10)
    write(tmp_path, "t\nu\nID,Note\n" + "".join(f"{n},x\n" for n in range(500)))
    found = records.Records(read_lines(spark, str(tmp_path)), header_depth([LIST]))
    assert found.early.count() < 20 and found.whole.count() == 503
    text = found.early._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag" in text


def test_waiver_lists_say_what_they_refuse(spark, tmp_path):
    write(tmp_path, 'ID,Check\n1,x\n2,"open\n')
    with pytest.raises(RejectedLines):
        read_waiver_lists(spark, str(tmp_path))
    rows, intake = read_waiver_lists(spark, str(tmp_path), on_rejected="keep")
    assert [r["ID"] for r in rows.collect()] == ["1"]
    assert [(r["value"], r["reason"]) for r in intake.rejected.collect()] == [('2,"open', "open quote")]
    write(tmp_path, "no,list\n", "c2")
    with pytest.raises(UnrecognizedSystem):
        read_waiver_lists(spark, str(tmp_path), on_rejected="keep")
