"""WARC packages and chat formatting."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zipfile

import pytest

from predia.llm import chat, warc
from tests.llm.helpers import bag

PAGES = "page_id long, url string, html string, payload string"


def expected_pages(rows):
    first: dict[bytes, int] = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        one = first.get(data)
        revisit = one is not None and page != one
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), sha, "revisit" if revisit else "response", one if revisit else None))
    return out


ROWS = [
    (5, "http://a", "<p>é</p>", "x"), (3, "http://b\nX: y", "<p>é</p>", "x"), (9, None, None, "x"), (8, "u", "", "x"),
    (7, "u", "x" * 100_000, "x"), (None, "u", "<p>é</p>", "x"), (11, "u", "\r\n\r\nWARC/1.1", "x"), (11, "u", "\r\n\r\nWARC/1.1", "x"),
]


def test_round_trip(spark):
    got = warc.round_trip(spark.createDataFrame(ROWS, PAGES))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert bag(tuple(r) for r in got.collect()) == bag(expected_pages(ROWS))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(spark, tmp_path, zip64):
    packages = warc.write_packages(spark.createDataFrame(ROWS, PAGES), str(tmp_path), most=2000, zip64=zip64)
    found = packages.collect()
    assert sum(r["n"] for r in found) == len(ROWS)
    for r in found:
        with zipfile.ZipFile(r["path"]) as package:
            assert package.testzip() is None
            assert gzip.decompress(package.read("archive/data.warc.gz")).count(b"WARC-Record-ID") == r["n"]
            assert len(package.read("indexes/index.cdx").split(b"\n")) == r["n"]
    payloads = {(r["page_id"], bytes(r["payload"])) for r in warc.read_records(packages).collect() if r["record_type"] == "response"}
    assert (7, b"x" * 100_000) in payloads and (11, b"\r\n\r\nWARC/1.1") in payloads


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "one.wacz")
    package = warc.Package(path)
    package.add(1, warc.record(1, "u", b"abc", warc.digest(b"other"), None, False))
    package.close()
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_records(spark.createDataFrame([(path, 1)], "path string, n long")).collect()


TURNS = "conv_id long, turn long, role string, text string, k string, tree string"


def turns(rows):
    return [(*r, "x", "x") for r in rows]


TALKS = turns([
    (1, 0, "user", "hello"), (1, 1, "assistant", "a </turn> ### x"), (2, 0, "user", "hello"), (2, 1, "assistant", "b\\"),
    (3, 0, "user", "hello"), (3, 1, "assistant", "a </turn> ### x"), (3, 2, "user", ": more\n"), (4, 0, "sys:tem", ""),
    (5, 3, "assistant", None), (5, 1, None, "x"), (None, 0, "user", "z"), (None, None, "user", "y"), (6, 0, "user", "hello"),
    (7, 0, "user", "hello"), (7, 0, "user", "hello"),
]) + turns([(8, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)])


def expected_talks(rows):
    talks: dict = {}
    for conv, turn, role, text, *_ in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, own in talks.items():
        own.sort()
        said = "".join(t for _, _, r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        out.append((conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return out


def test_chat_reads_back(spark):
    got = chat.round_trip(spark.createDataFrame(TALKS, TURNS))
    assert bag(tuple(r)[:5] for r in got.collect()) == bag(expected_talks(TALKS))


def test_no_chat(spark):
    assert chat.round_trip(spark.createDataFrame([], TURNS)).count() == 0


def test_shared_turns_are_emitted_once_depth_first(spark):
    emitted, walked = chat.sequence(spark.createDataFrame(TALKS, TURNS))
    emitted, walked = emitted.collect(), walked.collect()
    prefixes = set()
    talks: dict = {}
    for conv, turn, role, text, *_ in sorted(TALKS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        talks.setdefault(conv, []).append((role or "", text or ""))
        prefixes.add(tuple(talks[conv]))
    assert len(emitted) == len(prefixes)
    assert sum(r["formatted"].startswith("### user: hello</turn>") and r["position"] == 0 for r in emitted) == 1
    trees: dict = {}
    for r in emitted:
        trees.setdefault(r["tree"], []).append(r)
    for own in trees.values():
        own.sort(key=lambda r: r["start"])
        assert own[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(own, own[1:]))
        # Depth first: a turn continues its parent, which ends at its position in some open path.
        open_ = []
        for r in own:
            while open_ and open_[-1] > r["position"]:
                open_.pop()
            assert r["position"] == 0 or open_[-1] == r["position"]
            open_.append(r["position"] + len(r["formatted"]))
    by_place = {(r["tree"], r["start"]): r for r in emitted}
    for conv in {r["conv"] for r in walked}:
        at = 0
        for r in sorted((r for r in walked if r["conv"] == conv), key=lambda r: r["k"]):
            assert by_place[r["tree"], r["start"]]["position"] == at
            at += r["stop"] - r["start"]


def test_intervals_cover_the_walk(spark):
    _, walked = chat.sequence(spark.createDataFrame(TALKS, TURNS))
    sizes: dict = {}
    for r in walked.collect():
        sizes[r["conv"]] = sizes.get(r["conv"], 0) + r["stop"] - r["start"]
    for r in chat.intervals(walked).collect():
        ends = [(i["start"], i["stop"]) for i in r["attends"]]
        assert sum(b - a for a, b in ends) == sizes[r["conv"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
