"""Disc addresses and headers, chunk trees and object sections against plain Python."""

import struct

import pytest
from pyspark.sql import functions as F

from sectorlake.sources import disc, riff, tables


def test_addresses_boot_blocks_and_lines(spark):
    files = spark.createDataFrame([(k, n, b"x" * size) for k, n, size in ((3, "b.dat", 2049), (1, "boot.bin", 5000), (7, "c/d-e.txt", 0), (9, "f", 1))] + [(11, "null", None)], "k int, name string, content binary")
    got = {r["k"]: (r["bytes"], r["sectors"], r["lba"]) for r in disc.addresses(files, "k").collect()}
    assert got == {1: (5000, 3, 2), 3: (2049, 2, 5), 7: (0, 0, 7), 9: (1, 1, 7), 11: (0, 0, 8)}
    wide = {r["k"]: (r["sectors"], r["lba"]) for r in disc.addresses(files, "k", boot_blocks=10).collect()}
    assert wide[1] == (10, 2) and wide[3] == (2, 12)
    with pytest.raises(Exception, match="more blocks"):
        disc.addresses(files, "k", boot_blocks=2).collect()
    lines = {(r["part"], r["n"]): r["line"] for r in disc.header_lines(disc.addresses(files, "k"), "k", "name").collect()}
    assert lines["enum", 7] == "\tBINARY_LBA_C_D_E_TXT = 7," and lines["macro", 1] == "#define BINARY_LBA_BOOT_BIN 2" and len(lines) == 10
    assert disc.cue_sheet("a.bin") == 'FILE "a.bin" BINARY\n  TRACK 01 MODE1/2048\n    INDEX 01 00:00:00\n'


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


FMT = struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16)
FILES = {
    "nested": chunk(b"RIFF", b"WAVE" + chunk(b"LIST", b"adtl" + chunk(b"ICMT", b"wrong\0") + chunk(b"data", b"no")) + chunk(b"fmt ", FMT) + chunk(b"data", b"\1\0\2\0\3") + chunk(b"LIST", b"INFO" + chunk(b"INAM", b"odd\0") + chunk(b"ICMT", b" 0x10\t 020 tail\0") + chunk(b"ICMT", b"1 2\0"))),
    "coded": chunk(b"RIFF", b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 17, 1, 8000, 4000, 1, 4)) + chunk(b"fact", struct.pack("<I", 77)) + chunk(b"data", b"abc") + chunk(b"smpl", struct.pack("<9I", *[0] * 7, 1, 0) + struct.pack("<6I", 0, 0, 5, 9, 0, 0))),
    "no data": chunk(b"RIFF", b"WAVE" + chunk(b"fmt ", FMT)), "other": chunk(b"RIFF", b"AVI " + chunk(b"fmt ", FMT) + chunk(b"data", b"")), "empty": b"", "null": None,
}


def test_chunk_trees_and_details(spark):
    files = spark.createDataFrame(list(FILES.items()), "stream_id string, content binary")
    tree = riff.chunks(files)
    rows = sorted((r["number"], r["level"], r["chunk_id"], r["chunk_type"], r["last"]) for r in tree.where("stream_id = 'nested'").collect())
    assert rows == [
        (0, 0, "RIFF", "WAVE", 9), (1, 1, "LIST", "adtl", 3), (2, 2, "ICMT", None, 2), (3, 2, "data", None, 3), (4, 1, "fmt ", None, 4), (5, 1, "data", None, 5),
        (6, 1, "LIST", "INFO", 9), (7, 2, "INAM", None, 7), (8, 2, "ICMT", None, 8), (9, 2, "ICMT", None, 9),
    ]
    root = riff.descend_root(tree)
    assert {(r["stream_id"], r["number"]) for r in riff.descend(tree, root, "data").collect()} == {("nested", 5), ("coded", 3)}
    assert riff.descend(tree, riff.descend(tree, root, "LIST", "INFO"), "ICMT").first()["number"] == 8
    got = {r["stream_id"]: r for r in riff.details(files, loop_in_comment=True).collect()}
    assert set(got) == {"nested", "coded"}
    assert (got["nested"]["total_samples"], got["nested"]["loop_start"], got["nested"]["loop_end"], got["nested"]["info"]) == (2, 16, 17, {"INAM": "odd", "ICMT": " 0x10\t 020 tail"})
    assert (got["coded"]["total_samples"], got["coded"]["loop_start"], got["coded"]["loop_end"], got["coded"]["info"]) == (77, 5, 10, None)
    assert {r["stream_id"]: r["loop_start"] for r in riff.details(files).collect()} == {"nested": None, "coded": 5}


def test_comments_that_are_no_loops(spark):
    asked = ["1 2", "1", "one two", "1x 2", "08 9", "-3 4", "0 0", "", None, "1 2" + " " * 300, "+5 0X1f"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(asked)], "i int, c string").select("i", riff.comment_loop(F.col("c")).alias("l")).collect()
    assert {asked[r["i"]]: r["l"] and tuple(r["l"]) for r in rows} == {**dict.fromkeys(asked), "1 2": (1, 3), "-3 4": (-3, 5), "0 0": (0, 1), "+5 0X1f": (5, 32)}


def test_object_sections(spark):
    head = bytes(12) + struct.pack(">I", 2) + bytes(48)
    body = b"".join(n.ljust(16, b"\0") + struct.pack(">4I", at, size, 9, 1) + bytes(16) for n, at, size in ((b".text", 200, 3), (b".a-name-of-16-ch", 203, 2)))
    content = (head + body).ljust(200, b"\0") + b"abcde"
    got = tables.object_sections(spark.createDataFrame([("o", content), ("none", bytes(64))], "object string, content binary")).collect()
    assert [(r["n"], r["name"], r["offset"], r["size"], r["relocations_at"], r["relocations"], bytes(r["content"])) for r in got] == [(0, ".text", 200, 3, 9, 1, b"abc"), (1, ".a-name-of-16-ch", 203, 2, 9, 1, b"de")]
