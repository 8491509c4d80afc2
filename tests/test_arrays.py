"""Large arrays cut in ranges against the whole file, at borders of all kinds."""

import json
import random

import pytest

from gradeloom.plans import evaluate
from gradeloom.sources import arrays, inference

ODD = ["", "[", "]", "{,}", '"', "\\", "\\\\", '\\"', ",", "é😀", "a\nb", '"],[{"', "\\" * 7, "\\" * 8 + '"', "x" * 300]


def values(rng, depth=3):
    kind = rng.randrange(8 if depth else 4)
    if kind < 2:
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(4)))
    if kind < 4:
        return rng.choice([None, True, -1.5e3, 7])
    if kind < 6:
        return [values(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(ODD): values(rng, depth - 1) for _ in range(rng.randrange(4))}


def read(spark, folder, **options):
    files = inference.keyed(inference.read_files(spark, str(folder), recursive=True, **options))
    rows = inference._elements(files).selectExpr("path", "idx", "to_json(v) as v").collect()
    return {r.path: r.readable for r in files.select("path", "readable").collect()}, sorted((r.path, r.idx, json.dumps(json.loads(r.v), sort_keys=True)) for r in rows)


@pytest.mark.parametrize("span,piece,step", [(61, 1, 5), (1000, 300, 1 << 20)])
def test_pieces_equal_whole_files(spark, tmp_path, monkeypatch, span, piece, step):
    rng = random.Random(span)
    for k in range(4):
        listed = [values(rng) for _ in range([0, 1, 20, 30][k])]
        body = json.dumps(listed, ensure_ascii=k % 2 == 0, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")]) if k % 2 else None)
        (tmp_path / f"d{k}" / "m").mkdir(parents=True)
        (tmp_path / f"d{k}" / "m" / f"f {k}.json").write_text(rng.choice(["", " \n"]) + body + rng.choice(["", "\n"]), encoding="utf-8")
    monkeypatch.setattr(arrays, "STEP", step)  # the scan's own steps, in the test below
    whole = read(spark, tmp_path)
    cut = read(spark, tmp_path, split_bytes=0, span=span, piece=piece)
    assert cut == whole


def test_scan_steps_agree():
    rng = random.Random(3)
    for _ in range(12):
        body = json.dumps([values(rng, 2) for _ in range(6)], ensure_ascii=False).encode()

        class File:
            def read_at(self, n, at, body=body):
                return body[at : at + n]

        for step, span in ((1, 1), (3, 10), (1000, 17)):
            arrays_step, arrays.STEP = arrays.STEP, step
            try:
                state, depth, found = False, 0, []
                for lo in range(0, len(body), span):
                    hi = min(len(body), lo + span)
                    found += arrays._elements(File(), lo, hi, len(body), state, depth)
                    both = {s: (e, d) for s, e, d, _, _ in arrays._summary(File(), lo, hi)}
                    state, depth = both[state][0], depth + both[state][1]
            finally:
                arrays.STEP = arrays_step
            assert (state, depth) == (False, 0) and [json.loads(x) for x in found] == json.loads(body)


def test_files_that_are_no_arrays(spark, tmp_path):
    bodies = {"object": '{"a": [1, 2, 3]}', "cut": '[{"a": 1}, {"b": ', "string": '[1, "a]', "two": "[1][2]", "after": "[1, 2] x", "gap": "[1,,2]", "tail": "[1, 2, ]", "word": "[1, nul]", "text": '"[1, 2]"', "good": "[1, 2]", "none": " [ ] "}
    for name, body in bodies.items():
        (tmp_path / name / "m").mkdir(parents=True)
        (tmp_path / name / "m" / "r.json").write_text(body)
    for span in (4, 1000):
        files = inference.keyed(inference.read_files(spark, str(tmp_path), recursive=True, split_bytes=3, span=span, piece=1))
        assert {r.dataset for r in files.filter("readable").collect()} == {"good", "none"}
        assert {r.dataset for r in files.filter("not readable").collect()} == set(bodies) - {"good", "none"}
        assert inference._elements(files).count() == 2


def test_points_of_a_whole_file(spark, tmp_path):
    """Q3 over pieces: points of one element decide for all of its file; ids are numbered through; the newest file is one file."""
    rows = [{"prediction": "\\boxed{1}", "answer": "1", "point": 5} for _ in range(50)]
    rows[49]["points"] = 2
    (tmp_path / "D/M").mkdir(parents=True)
    (tmp_path / "D/M/r.json").write_text(json.dumps(rows, indent=2))
    engine = evaluate.Engine(spark, str(tmp_path), str(tmp_path / "out"))
    files = inference.newest(inference.keyed(inference.read_files(spark, f"{tmp_path}/D/M", split_bytes=100, span=333, piece=200)), ["dataset", "model"])
    assert files.count() > 10
    got = [(r.idx, r.question_id, r.points) for r in inference.problems(files).orderBy("idx").collect()]
    assert got == [(k, f"D/M_{k + 1}", [2.0] if k == 49 else [0.0]) for k in range(50)]
    assert [(r.idx, r.question_id, r.points) for r in inference.problems(engine.files()).orderBy("idx").collect()] == got


def test_a_range_reads_little_beyond_its_end():
    """A small range in a long file is read to the end of its last element, not to the end of the file."""
    body, read = ("[" + ",".join(f'{{"id": {k}, "text": "é ] ,"}}' for k in range(20000)) + "]").encode(), []

    class File:
        def read_at(self, n, at):
            read.append(n)
            return body[at : at + n]

    lo, hi = 0, 400
    found = list(arrays._elements(File(), lo, hi, len(body), False, 0))
    assert [json.loads(x)["id"] for x in found] == list(range(len(found))) and len(found) >= 10
    assert sum(read) <= 2000  # the whole file before


def test_ranges_side_by_side_are_one_read():
    body, read = bytes(range(256)) * 4000, []

    class File:
        def read_at(self, n, at):
            read.append(n)
            return body[at : at + n]

    near = arrays.Near(File())
    for at in range(0, len(body), 400):
        assert near.read_at(400, at) == body[at : at + 400] and near.read_at(min(at, 1024), max(0, at - 1024)) == body[max(0, at - 1024) : at]
    assert near.read_at(arrays.AHEAD + 5, 3) == body[3 : arrays.AHEAD + 8] and len(read) <= 8
