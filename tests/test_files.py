from collections import Counter

from pyspark.sql import functions as F

from tarnflow.plans import catalog


def test_files_are_dealt_to_tasks(spark, sf, tmp_path, monkeypatch):
    """Before, a table of one part was written by one task a folder, with a checksum file beside each page."""
    monkeypatch.setattr(catalog, "shared_folder", lambda _: str(tmp_path / "out"))
    monkeypatch.setattr(catalog, "FILES_PER_TASK", 3, raising=False)
    pages = catalog.table(spark, sf, "pages").limit(40)
    pages.coalesce(1).write.parquet(str(tmp_path / "in/pages.parquet"))
    got = Counter(r["content_md5"] for r in catalog.files_loaded(spark, str(tmp_path / "in")).collect())
    assert got == Counter(r[0] for r in pages.where("html IS NOT NULL").select(F.md5(F.concat("html", F.lit("\n")).cast("binary"))).collect())
    names = [p for p in (tmp_path / "out").rglob("*part-*")]
    assert len(names) == sum(got.values()) and not any(p.suffix == ".crc" for p in names)
    assert max(Counter((p.parent, p.name[:10]) for p in names).values()) <= 3
