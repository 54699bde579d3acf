"""Content sums of files of any size; broken records and damaged files."""

import gzip
import hashlib
import os

from plaudit.sources import ingest, io


def test_content_sums_of_large_files(spark, tmp_path):
    data = os.urandom(10_007)
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "large file").write_bytes(data)

    def sums():
        return {r["path"].rsplit("/", 1)[1].replace("%20", " "): r["md5"] for r in
                io.content_sums(spark, f"{tmp_path}/*", whole=1000, block=1000).collect()}

    blocks = [hashlib.md5(data[i:i + 1000]).digest() for i in range(0, len(data), 1000)]
    want = hashlib.md5(b"".join(blocks)).hexdigest() + "-11"
    assert sums() == {"small": hashlib.md5(b"abc").hexdigest(), "large file": want}
    manifest = io.changed_files(spark, f"{tmp_path}/*", whole=1000, block=1000).select(
        "path", "md5", io.F.current_timestamp().alias("checked_at"))
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    times = os.stat(tmp_path / "large file")
    (tmp_path / "large file").write_bytes(data[:5000] + bytes([data[5000] ^ 1]) + data[5001:])
    os.utime(tmp_path / "large file", ns=(times.st_atime_ns, times.st_mtime_ns))
    got = io.changed_files(spark, f"{tmp_path}/*", manifest, whole=1000, block=1000).collect()
    assert [(r["path"].rsplit("/", 1)[1].replace("%20", " "), r["reason"]) for r in got] == [("large file", "changed")]


def test_import_files(spark, tmp_path):
    head = "recommendationid,review,voted_up\n"
    (tmp_path / "A_1_reviews.csv").write_text(head + '1,"two\nlines",1\n2,short\n3,x,0,more\n,no id,1\n')
    (tmp_path / "B_2_reviews.csv").write_text("review,recommendation_id\nb,1\nc,9\n")
    (tmp_path / "C_3_reviews.csv").write_text("")
    whole = gzip.compress((head + "".join(f"{i},{os.urandom(40).hex()},1\n" for i in range(50, 90))).encode())
    (tmp_path / "D_4_reviews.csv.gz").write_bytes(whole)
    (tmp_path / "E_5_reviews.csv.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "F_6_reviews.csv.gz").write_bytes(b"not packed")
    stored = spark.createDataFrame([("9",)], "recommendation_id string")
    good, rejects, summary = ingest.import_files(spark, str(tmp_path), "*_reviews.csv*", stored)
    got = {r["file_path"].rsplit("/", 1)[1][0]: tuple(r)[1:] for r in summary.collect()}
    assert got == {"A": (4, 3, 1, 0, "imported"), "B": (2, 0, 0, 2, "skipped"), "C": (0, 0, 0, 0, "empty"),
                   "D": (40, 0, 40, 0, "imported"), "E": (0, 0, 0, 0, "unreadable"), "F": (0, 0, 0, 0, "unreadable")}
    assert sorted(r["review"] for r in good.collect() if r["file_name"][0] in "AB") == ["b", "c", "two\nlines"]
    records = sorted(r["record"] for r in rejects.collect())
    assert records[:2] == ["2,short", "3,x,0,more"] and '"no id"' in records[2]
