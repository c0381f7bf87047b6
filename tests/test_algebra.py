"""Properties of the algebra, strict guards, and identity."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from snaptide.operators import algebra as A
from snaptide.operators.keys import MatchMode as M
from snaptide.operators.keys import keyed
from snaptide.plans import transfer

SCHEMA = "id bigint, run_id bigint, run_path string, path_prefix string, case_sensitive boolean, rel string, filename string, extension string, content_id bigint, file_size bigint, hash string, hash_begin string, reference_inode bigint, created timestamp, modified timestamp, in_archive boolean"


def files(spark, rows):
    """rows: (id, rel, filename, hash or None)."""
    out = [(i, 1, "/d/", "", True, rel, name, None, None if h is None else i, None if h is None else len(h), h, h, None, None, None, False) for i, rel, name, h in rows]
    return spark.createDataFrame(out, SCHEMA)


row = st.tuples(st.sampled_from(["/a/", "/b/"]), st.sampled_from(["x", "y", "z"]), st.sampled_from([None, "h1", "h2", "h33"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=8), st.lists(row, max_size=8))
def test_intersect_and_subtract_part_the_left_side(spark, left, right):
    a = files(spark, [(i, *r) for i, r in enumerate(left)])
    b = files(spark, [(100 + i, *r) for i, r in enumerate(right)])
    modes = M.HASH | M.FILE_SIZE
    key = lambda r: (r[2] and len(r[2]) or 0, r[2], r[1] if r[2] is None else None)
    theirs = {key(r) for r in right}
    assert {r.id for r in A.subtract(a, b, modes).collect()} == {i for i, r in enumerate(left) if key(r) not in theirs}
    pairs = A.intersect(a, b, modes)
    assert pairs.count() == sum(key(x) == key(y) for x in left for y in right)
    assert {r.id for r in A.semi(a, b, modes).collect()} == {r.l_id for r in pairs.collect()}
    both = {key(r) for r in left} | theirs
    assert A.union(a, b, modes, strict=False).count() == len(both)
    assert A.unique(a, modes).count() == len({key(r) for r in left})


def test_strict_forms_raise_on_repeats_even_when_counted(spark):
    a = files(spark, [(1, "/a/", "x", "h"), (2, "/a/", "x", "h")])
    b = files(spark, [(3, "/a/", "x", "h")])
    modes = M.REL_PATH2 | M.FILENAME
    for run in (
        lambda: A.intersect(a, b, modes, multi=False),
        lambda: A.intersect(b, a, modes, multi=False),
        lambda: A.subtract(a, b, modes, multi=False),
        lambda: A.subtract(b, a, modes, multi=False),
        lambda: A.union(a, b, modes),
        lambda: A.unique(a, modes, strict=True),
        lambda: transfer.classified(a, b),
    ):
        with pytest.raises(Exception, match="key is not unique"):
            run().count()


def test_empty_files_match_only_by_name(spark):
    a = files(spark, [(1, "/a/", "x", None), (2, "/a/", "y", None)])
    b = files(spark, [(3, "/b/", "x", None)])
    assert [r.l_id for r in A.intersect(a, b, M.HASH).collect()] == [1]


def test_names_with_separators_do_not_collide(spark):
    a = files(spark, [(1, "/a@b/", "c", "h"), (2, "/a/", "b@c", "h")])
    assert keyed(a, M.REL_PATH2 | M.FILENAME).select("__key").distinct().count() == 2


def test_one_check_covers_a_side_only(spark):
    a, b = files(spark, [(1, "/a/", "x", "h")]), files(spark, [(2, "/a/", "x", "h")])
    assert [r.id for r in A.union(a, b, M.HASH).collect()] == [1]


def test_cascade_takes_each_row_once(spark):
    source = files(spark, [(1, "/a/", "x", "h1"), (2, "/a/", "y", "new"), (3, "/a/", "r", "h3"), (4, "/m/", "z", "h4"), (5, "/n/", "q", "h5"), (6, "/a/", "n", "h6")])
    old = files(spark, [(11, "/a/", "x", "h1"), (12, "/a/", "y", "old"), (13, "/a/", "s", "h3"), (14, "/a/", "z", "h4"), (15, "/o/", "p", "h5"), (17, "/a/", "g", "h7")])
    got = {r.id: r.change for r in transfer.changes(source, old).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "renamed", 4: "moved", 5: "renamed+moved", 6: "new", 17: "deleted"}


def test_expected_counts_of_the_two_runs(spark):
    from snaptide.plans.fixture import files as run

    sf = "/root/testdata/sf0.01"
    got = {r.change: r.files for r in transfer.totals(transfer.changes(run(spark, sf, 2), run(spark, sf, 1))).collect()}
    assert got == {"unchanged": 641, "changed": 35, "renamed": 50, "moved": 40, "renamed+moved": 5, "new": 138, "deleted": 86}
