"""Tables larger than what one sheet of a workbook holds."""

from __future__ import annotations

import io

from gradeloom.sources import workbooks


def _book(rows: int) -> bytes:
    out = io.BytesIO()
    book = workbooks.Writer(out, ["a", "b"])
    for k in range(rows):
        book.row([k, f"x{k}"])
    book.close()
    return out.getvalue()


def test_a_table_over_several_sheets_is_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    (tmp_path / "many.xlsx").write_bytes(_book(7))
    found = workbooks.read(spark, str(tmp_path / "many.xlsx"))
    assert sorted(map(tuple, found.collect())) == [(k, f"x{k}") for k in range(7)]
    assert [[c[1] for c in r] for r in workbooks.table_rows(_book(2))] == [["a", "b"], ["0", "x0"], ["1", "x1"]]


def test_sheets_of_other_tables_are_left_alone(monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    monkeypatch.setattr(workbooks, "CONTINUED", "other")
    content = _book(5)
    monkeypatch.setattr(workbooks, "CONTINUED", "gradeloom_sheets")
    assert [r[0][1] for r in workbooks.table_rows(content)] == ["a", "0", "1"]
