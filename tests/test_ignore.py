"""Ignore rules of nested folders."""

import pytest

from mnemospark.sources import files

TREE = {
    ".gitignore": "*.log\n/build/\n!keep.log\ndocs/*.tmp\n# a remark\nsecret\n",
    "a.txt": "", "x.log": "", "keep.log": "", "build/out.txt": "", "build/keep.log": "", "sub/build/in.txt": "",
    "docs/a.tmp": "", "docs/deep/a.tmp": "", "docs/a.md": "", "secret": "", "sub/secret/b.txt": "", "top.bak": "",
    "sub/.gitignore": "!*.log\nlocal/\n/only.txt\n", "sub/x.log": "", "sub/y/x.log": "", "sub/local/a.txt": "", "local/a.txt": "", "sub/only.txt": "", "sub/y/only.txt": "",
    "sub/y/.gitignore": "x.log\n", "sub/y/z/x.log": "", "sub/y/z/w.log": "",
    "sub/.ignore": "w.log\n!top.bak\n", "sub/w.log": "", "sub/top.bak": "", "sub/y/z/top.bak": "", "a b/ü.log": "", "a b/ü.txt": "",
}
KEPT = {
    "a.txt", "keep.log", "sub/build/in.txt", "docs/deep/a.tmp", "docs/a.md", "sub/x.log", "local/a.txt", "sub/y/only.txt",
    "sub/top.bak", "sub/y/z/top.bak", "a b/ü.txt",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text or "some text")
    return str(root)


def kept(spark, project, include=(), rules=("*.bak",)):
    found = files.whole_texts(spark, project)
    left = files.not_ignored_below(found, files.ignore_rules(spark, project, list(rules)), list(include))
    return {r["relative"] for r in left.select("relative").collect() if not r["relative"].endswith(files.RULE_FILES)}


def test_the_deepest_rule_that_fits_decides(spark, project):
    assert kept(spark, project) == KEPT


def test_included_places_stay_and_global_rules_come_last(spark, project):
    assert kept(spark, project, ["build", "sub/local/a.txt"]) == KEPT | {"build/out.txt", "build/keep.log", "sub/local/a.txt"}
    assert kept(spark, project, rules=()) == KEPT | {"top.bak"}


def test_no_rules(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert kept(spark, str(tmp_path)) == {"a.txt"}
