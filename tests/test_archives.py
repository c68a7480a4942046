"""Directories of archives by column functions against the standard reader; office and RTF texts; fetched files."""

import hashlib
import http.server
import io
import threading
import time
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from catalume.operators import mutations
from catalume.sources import archives, fetch, files
from catalume.sources.rtf import rtf_text


class Old(zipfile.ZipInfo):
    """An entry whose name is in another encoding, without the flag of UTF-8."""

    def _encodeFilenameFlags(self):
        return self.comment_name, self.flag_bits


def old(name: bytes) -> Old:
    info = Old("x")
    info.comment_name = name
    return info


def made(*entries, comment=b"", before=b"", **options):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", **options) as z:
        for name, body in entries:
            z.writestr(name, body)
        z.comment = comment
    return before + data.getvalue()


def with_time(name, when, extra=b"", comment=b""):
    info = zipfile.ZipInfo(name, when)
    info.extra, info.comment = extra, comment
    return info


def standard(data):
    """What the standard library reads."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for e in z.infolist():
            name = e.orig_filename
            if not e.flag_bits & 0x800:
                raw = name.encode("cp437")
                for codec in ("utf-8", "cp932", "cp437"):
                    try:
                        name = raw.decode(codec)
                        break
                    except UnicodeDecodeError:
                        pass
            try:
                when = datetime(*e.date_time).isoformat()
            except ValueError:
                when = archives.NO_TIME
            out.append((name, e.file_size, e.compress_size, when, name.endswith("/")))
    return sorted(out)


def wide_directory(data):
    """The same archive with a 64-bit end record, as one of very many entries has."""
    at = data.rindex(b"PK\x05\x06")
    n, size, offset = (int.from_bytes(data[at + a : at + a + k], "little") for a, k in ((10, 2), (12, 4), (16, 4)))
    record = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\x2d\x00\x2d\x00" + bytes(8) + n.to_bytes(8, "little") * 2 + size.to_bytes(8, "little") + offset.to_bytes(8, "little")
    locator = b"PK\x06\x07" + bytes(4) + at.to_bytes(8, "little") + (1).to_bytes(4, "little")
    return data[:at] + record + locator + b"PK\x05\x06" + bytes(4) + b"\xff\xff\xff\xff" + b"\xff" * 8 + bytes(2)


CASES = {
    "plain": made(("x/", ""), ("x/one.txt", "hello"), ("two.txt", "")),
    "deflated": made(("a.txt", "a" * 5000), compression=zipfile.ZIP_DEFLATED),
    "names": made(("日本/表.csv", "x"), (old("日本.csv".encode("cp932")), "y"), (old("東京.csv".encode()), "z"), (old(b"\xff\xfd"), "w")),
    "times": made((with_time("a", (1980, 1, 1, 0, 0, 0)), ""), (with_time("b", (2107, 12, 31, 23, 59, 58)), ""), (with_time("c", (2023, 2, 30, 1, 2, 4)), ""), (with_time("d", (2024, 0, 0, 0, 0, 0)), "")),
    "comment": made(("a", "b"), comment=b"a comment " * 500),
    "behind a program": made(("a", "b"), ("c", "dd"), before=b"#!/bin/sh\nexit\n"),
    "signature in a name": made((old(b"a PK\x01\x02 b"), "x"), ("after", "yy"), (old(b"PK\x01\x02PK\x01\x02"), "zzz"), ("last", "")),
    "signature in a comment": made((with_time("a", (2020, 1, 1, 0, 0, 0), comment=b"PK\x01\x02" * 9), "x"), ("b", "yy")),
    "extra fields": made((with_time("a", (2020, 1, 1, 0, 0, 0), extra=b"\x55\x54\x05\x00\x03abcd"), "x")),
    "many": made(*[(f"{i // 50}/{i}", "x" * (i % 7)) for i in range(2000)]),
    "wide": wide_directory(made(("a", "b"), ("c/", ""), ("c/d", "eee"))),
}


@pytest.fixture(scope="module")
def entries(spark):
    odd = [("empty", made()), ("bad", b"PK nothing"), ("none", None), ("cut", CASES["many"][:-40]), ("no bytes", b""), ("end only", b"PK\x05\x06"), ("wrong size", made()[:12] + b"\x99\x00\x00\x00" + made()[16:])]
    rows = spark.createDataFrame([*CASES.items(), *odd], "path string, content binary")
    found: dict = {}
    for r in archives.zip_entries(rows).collect():
        found.setdefault(r.path, []).append(tuple(r)[1:])
    return found


@pytest.mark.parametrize("name", sorted(CASES))
def test_entries_are_those_of_the_standard_reader(entries, name):
    assert sorted(entries[name]) == standard(CASES[name])


def test_archives_that_cannot_be_read_have_no_entry(entries):
    assert set(entries) == set(CASES)


def test_sizes_of_64_bits(spark):
    data = bytearray(made((with_time("big", (2020, 1, 1, 0, 0, 0), extra=b"\x55\x54\x01\x00x" + b"\x01\x00\x10\x00" + (5 << 32).to_bytes(8, "little") + (3 << 32).to_bytes(8, "little")), "x")))
    at = data.rindex(b"PK\x01\x02")
    data[at + 20 : at + 28] = b"\xff" * 8
    (r,) = archives.zip_entries(spark.createDataFrame([("a", bytes(data))], "path string, content binary")).collect()
    assert (r["size"], r.compressed_size) == (5 << 32, 3 << 32)


def test_rtf():
    source = r"{\rtf1\ansi\ansicpg932{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0 \b Hello\b0  world\par \'93\'fa\'96\'7b\par\uc1\u-10179?\u-8704? caf\'65 {\pict 0011}\\ \{a\}" + "\n\\par  \\par\\tab end}"
    assert rtf_text(source.encode()) == "Hello world\n日本\n😀 cafe \\ {a}\nend"
    assert rtf_text(rb"{\rtf1 caf\'e9 {\uc2\u26085\'93\'fa!}\bin3 {{{ok") == "café 日!ok"
    assert rtf_text(rb"{\rtf1}") == ""
    with pytest.raises(ValueError):
        rtf_text(b"plain")


class Pages(http.server.BaseHTTPRequestHandler):
    protocol_version, asked = "HTTP/1.1", []

    def log_message(self, *args):
        pass

    def do_GET(self):
        Pages.asked.append((self.path, time.monotonic()))
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/ok")
            self.send_header("Content-Length", "0")
            return self.end_headers()
        if self.path == "/inside":
            self.send_response(302)
            self.send_header("Location", "file:///etc/hostname")
            self.send_header("Content-Length", "0")
            return self.end_headers()
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Connection", "close")
        self.close_connection = True
        if self.path in ("/ok", "/same", "/gone", "/announced", "/cut"):
            self.send_header("Content-Length", {"/announced": "5000", "/cut": "50"}.get(self.path, "5"))
        self.end_headers()
        try:
            if self.path == "/stream":
                for _ in range(1000):
                    self.wfile.write(b"x" * 1000)
            elif self.path == "/slow":
                for _ in range(40):
                    self.wfile.write(b"x")
                    self.wfile.flush()
                    time.sleep(0.1)
            elif self.path != "/announced":
                self.wfile.write(b"hello")
        except OSError:
            pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_fetched_files(spark, site):
    known = "sha256:" + hashlib.sha256(b"hello").hexdigest()
    pages = ("ok", "same", "moved", "gone", "announced", "stream", "slow", "cut", "inside")
    rows = [(p, f"{site}/{p}", known if p == "same" else None) for p in pages]
    rows += [("none", None, None), ("no host", "not an address", None), ("own file", "file:///etc/hostname", None), ("nobody", "http://127.0.0.1:1/x", None)]
    resources = spark.createDataFrame(rows, "id string, url string, hash string")
    Pages.asked.clear()
    found = fetch.fetch(resources, most=1000, timeout=1.5, interval=0.1).collect()
    got = {r.id: r for r in found}
    assert len(found) == len(rows)
    assert {i for i, r in got.items() if r.error is None} == {"ok", "same", "moved"}
    assert all((bytes(got[i].content), got[i].hash, got[i]["size"]) == (b"hello", known, 5) for i in ("ok", "same", "moved"))
    assert got["ok"].changed and not got["same"].changed
    assert {i: r.error for i, r in got.items() if r.error} == {
        "gone": "status 404", "announced": "too large", "stream": "too large", "slow": "too slow", "cut": "cut off", "inside": "status 302",
        "none": "no address", "no host": "no address", "own file": "no address", "nobody": "unreachable",
    }
    times = sorted(t for path, t in Pages.asked if path != "/ok")
    assert times[-1] - times[0] > 0.1 * (len(times) - 1) - 0.2  # less what the way to the server may take
    kept = mutations.patch(resources.withColumn("size", F.lit(None).cast("long")), spark.createDataFrame([(r.id, r.hash, r["size"]) for r in found if r.changed], "id string, hash string, size long"), "id")
    assert {r.id for r in kept.where("size IS NOT NULL").collect()} == {"ok", "moved"}
    assert fetch.fetch(resources.limit(0)).count() == 0


def test_office_texts_of_every_kind(spark):
    rtf = rb"{\rtf1\ansi One\par two}"
    rows = [("a", rtf, "RTF"), ("b", b"no", "rtf"), ("c", b"x", "pdf"), ("d", rtf, None)]
    got = {r.path: (r.text, r.error) for r in files.document_texts(spark.createDataFrame(rows, "path string, content binary, format string")).collect()}
    assert got == {"a": ("One\ntwo", None), "b": (None, "not RTF"), "c": (None, "unsupported"), "d": (None, "unsupported")}
