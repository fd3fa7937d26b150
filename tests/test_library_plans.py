"""Registered queries over whole tables."""

import pytest

from stratalens.plans import library


@pytest.fixture
def media(spark, tmp_path):
    """Two runs; two files of run 1 are all that is left of x/gone, one of them was deleted in a later delivery."""
    rows = [
        (1, 1, "/x/b.jpg", None, 1), (2, 1, "/x/a/c.jpg", None, 1), (3, 1, "/x/z.jpg", None, 1), (4, 1, "/x/gone/in/d.jpg", "2024", 1), (5, 1, "/x/a/e.jpg", None, 1),
        (5, 1, "/x/a/e.jpg", "2024", 2), (6, 8, "/x/b.jpg", None, 1), (7, 8, "/x/a.jpg", None, 1), (8, 1, "/x/gone/f.jpg", "2024", 1),
    ]
    df = spark.createDataFrame([(i, r, p, p.rpartition("/")[2], d, n, None, "h", 0.5) for i, r, p, d, n in rows], "id long, run_id long, path string, filename string, deleted_at string, loaded_at long, group_id long, content_hash string, quality_score double")
    df.write.parquet(str(tmp_path / "media_files.parquet"))
    return str(tmp_path)


def test_walk_order_of_all_runs(spark, media):
    got = sorted((r.position, r.run_id, r.id) for r in library.queries()["walk_order_all"](spark, media).collect())
    assert got == [(1, 1, 1), (2, 1, 3), (3, 1, 2), (4, 1, 5), (5, 1, 8), (6, 1, 4), (7, 8, 7), (8, 8, 6)]


def test_report_files_of_all_runs(spark, media):
    got = [(r.run_id, r.path, r.id) for r in library.queries()["report_files_all"](spark, media).collect()]
    assert got == sorted(got) and len(got) == 8 and {r for r, _, _ in got} == {1, 8}


def test_all_pairs_are_counted_from_those_found(spark, tmp_path, monkeypatch):
    vector = lambda k: [1.0 if i == k else 0.0 for i in range(64)]
    rows = [(n, vector(k)) for n, k in enumerate([0, 0, 0, 5, 5, 9])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    count = lambda: library.queries()["hamming_threshold_all"](spark, str(tmp_path)).first().n_pairs
    assert count() == 15
    near_edges = library.hamming.near_edges
    monkeypatch.setattr(library.hamming, "near_edges", lambda reps, threshold: near_edges(reps, threshold).where("ord_b <> 5"))
    assert count() == 10  # a pair lost by the join is lost in the count


def test_directories_left_empty_by_deletions(spark, media):
    assert [r.rel for r in library.queries()["empty_dirs_all"](spark, media).collect()] == ["x/gone/in", "x/gone"]
