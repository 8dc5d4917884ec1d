"""Hidden names in folders, and sessions longer than the old limits."""

from mnemospark.sources import files, transcripts


def test_hidden_names_are_read(spark, tmp_path):
    texts = {
        "pkg/__init__.py": "a = 1", ".github/guide one.md": "Übung", "_notes/deep/er.txt": "c\n\nd", ".env": "", "plain.txt": "e",
        "50%25 +1/_a.md": "f",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "_binary.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / ".gitignore").write_text("build/\n")
    rows = files.whole_texts(spark, str(tmp_path)).collect()
    assert {r["relative"]: r["content"] for r in rows} == texts and len(rows) == len(texts)
    assert {r["path"] for r in rows} == {str(tmp_path / name) for name in texts}


def test_sessions_are_read_whole(spark):
    banner = "Claude Code v1.0"
    late = [banner] + ["x"] * 120 + ["⏺ 9:05 AM Monday, March 7, 2025", "Alice said hi"]
    df = spark.createDataFrame([("/logs/a.txt", "\n".join(late + [banner] + ["z"] * 10))], "path string, content string")
    name = lambda **limits: transcripts.session_parts(df, **limits).orderBy("part").first()["file_name"]
    assert name() == "a_2025-03-07_905AM_Alice_session.txt"
    assert name(stamp_lines=50, people_lines=100) == "a_part01_unknown_session.txt"
