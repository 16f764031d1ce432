from __future__ import annotations

from longtake.operators import export


def cues(spark, counts):
    rows = [(job, i, float(i), i + 1.0, f"{job} line {i}") for job, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "job_id string, cue_no long, start double, end double, text string").repartition(5)


lines = lambda job, part_no, found: "".join(f"{text}\n" for _, _, text in found)
lines.__module__ = "__main__"  # workers cannot import this file


def test_parts_of_a_recording_make_one_file_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "PART_CUES", 10)
    result = export.Renderers().add("txt", lines).export(cues(spark, {"a": 35, "b/c": 3}), str(tmp_path))
    assert (tmp_path / "a.txt").read_text() == "".join(f"a line {i}\n" for i in range(35))
    assert (tmp_path / "b_c.txt").read_text().count("\n") == 3
    assert {(r.job_id, r.parts, r.bytes) for r in result.published.collect()} == {
        ("a", 4, (tmp_path / "a.txt").stat().st_size), ("b/c", 1, (tmp_path / "b_c.txt").stat().st_size)
    }
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_attempt")]


def test_a_failing_renderer_is_listed_and_can_be_replayed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "PART_CUES", 10)
    table = cues(spark, {"a": 25, "b": 5})

    def breaks(job, part_no, found):
        if job == "a" and part_no == 1:
            raise KeyError("no")
        return None if job == "b" else lines(job, part_no, found)

    first = export.Renderers().add("txt", lines).add("md", breaks).export(table, str(tmp_path))
    assert sorted(p.name for p in tmp_path.glob("*.*")) == ["a.txt", "b.txt"]
    assert {(r.job_id, r.renderer, r.part_no, r.error) for r in first.failed.collect()} == {
        ("a", "md", 1, "KeyError: 'no'"), ("b", "md", 0, "renderer gave no text")
    }
    (tmp_path / "a.txt").write_text("kept")
    again = export.Renderers().add("txt", lines).add("md", lines).export(table, str(tmp_path), only=first.failed)
    assert (tmp_path / "a.txt").read_text() == "kept" and (tmp_path / "a.md").read_text().count("\n") == 25
    assert again.failed.count() == 0 and again.published.count() == 2


def test_nothing_to_render(spark, tmp_path):
    result = export.Renderers().add("txt", lines).export(cues(spark, {"a": 0, "b": 1}).where("job_id = 'a'"), str(tmp_path))
    assert result.published.count() == result.failed.count() == 0 and not list(tmp_path.glob("*.*"))
