"""The scan of a file tree against os.walk."""

import hashlib
import os

from pyspark.sql import functions as F

from foliant.sources import scan


def tree(root):
    for k in range(40):
        folder = root / f"d{k % 7}" / f"e{k % 3}" / ("deep/" * (k % 4))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.txt").write_bytes(bytes([k]) * (k * 200))
    (root / "top.pdf").write_bytes(b"x" * 5000)
    os.link(root / "top.pdf", root / "d1" / "linked.pdf")
    os.symlink(root / "d2", root / "loop")
    os.symlink(root / "nowhere", root / "broken")


def walked(root):
    found = {}
    for folder, _, names in os.walk(root):
        for n in names:
            p = os.path.join(folder, n)
            if not os.path.islink(p):
                s = os.lstat(p)
                found[p] = (s.st_size, int(s.st_mtime), s.st_dev, s.st_ino, open(p, "rb").read()[:1024])
    return found


def test_scan_equals_a_walk(spark, tmp_path):
    tree(tmp_path)
    for parts in (1, 3, 64):
        got = scan.scan(spark, str(tmp_path), partitions=parts).collect()
        assert {r.path: (r.size_bytes, r.modified_at_fs, r.filesystem_device, r.inode, bytes(r.head)) for r in got} == walked(tmp_path) and len(got) == 42
    assert any(r.size_bytes == 0 for r in got)
    (tmp_path / "@eaDir").mkdir()
    (tmp_path / "@eaDir" / "thumb").touch()
    assert scan.scan(spark, str(tmp_path)).count() == 43 and scan.listed(scan.scan(spark, str(tmp_path)), str(tmp_path)).count() == 42
    assert {r["head"] for r in scan.scan(spark, str(tmp_path), head=0).collect()} == {None}
    assert scan.scan(spark, str(tmp_path / "missing")).count() == 0


def test_first_bytes_alone_are_read(tmp_path, monkeypatch):
    tree(tmp_path)
    read = []
    real = open

    def counting(path, *args, **kwargs):
        f = real(path, *args, **kwargs)

        class Counted:
            def read(self, n):
                out = f.read(n)
                read.append(len(out))
                return out

            def __enter__(self):
                return self

            def __exit__(self, *x):
                f.close()

        return Counted()

    monkeypatch.setattr("builtins.open", counting)
    reader = scan.FileScanReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 42 and sum(read) == sum(min(r[1], 1024) for r in rows) < sum(r[1] for r in rows)


def test_fingerprints_read_changed_documents_only(spark, tmp_path, monkeypatch):
    tree(tmp_path)
    scanned = scan.scan(spark, str(tmp_path))
    prior = scanned.where("path like '%f1_.txt'").select("path", "size_bytes", "modified_at_fs", F.lit("old").alias("content_sha256"))
    stale = prior.where("path like '%f11.txt'").withColumn("size_bytes", F.lit(1).cast("long"))
    got = {r.path: r for r in scan.file_fingerprints(scanned, prior.where("path not like '%f11.txt'").unionByName(stale)).collect()}
    for p, (size, *_, head) in walked(tmp_path).items():
        kept = "/f1" in p and p[-6:-4] != "f1" and not p.endswith("f11.txt")
        want = None if not size else "old" if kept else hashlib.sha256(open(p, "rb").read()).hexdigest()
        assert (got[p].hash_head, got[p].content_sha256) == (hashlib.sha256(head).hexdigest(), want)
