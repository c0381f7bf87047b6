"""Settings and command lines."""

import os

import pytest

from snaptide.cli import HELP, Session
from snaptide.config import Config


def test_options_are_read_without_case():
    c = Config().with_options({"fastmode": "no", "MaxThreads": "3", "excludedpaths": "{b, a,b}", "pathfilter": "x"})
    assert not c.fast_mode and c.max_threads == 3 and c.excluded_paths == ("a", "b") and c.extra == {"pathfilter": "x"}
    with pytest.raises(ValueError):
        Config().with_options({"dryRun": "perhaps"})
    with pytest.raises(ValueError):
        Config().with_options({"readConfig": "tape"})


def test_a_session(spark, tmp_path):
    root = tmp_path / "d"
    root.mkdir()
    for name in ("a.txt", "b.txt", "thumbs.db"):
        (root / name).write_text(name * 200)
    s = Session(spark, Config(db=str(tmp_path / "cat")))
    assert len(s.run("help")) == len(HELP) and "fast_mode = True" in s.run("status")
    assert [r.files for r in s.run(f"index {root}").collect()] == [2]
    os.utime(root / "b.txt", (1, 1))
    assert sorted(r.outcome for r in s.run(f"verify {root}").collect()) == ["date differs", "ok"]
    assert s.run("removeIndex 1").filter("n > 0").count() == 0
