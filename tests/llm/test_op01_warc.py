import random

import pytest

from graphloom.llm import op01_warc as O


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def brute(data):
    """Try every byte as the begin of a record; nothing is searched for."""
    src, at, out, gap = O.Source(Bytes(data)), 0, [], None
    while at < len(data):
        try:
            if data[at : at + 3] != O.MAGIC and gap is not None and at and data[at - 1 : at] != b"\n":
                raise O.Bad("not at a line")
            ((end, fields, block),) = O.parse(src, at)
        except O.Bad as e:
            if gap is None:
                gap = (at, str(e))
            at += 1
            continue
        if gap:
            out.append(("gap", gap[0], at - gap[0], gap[1]))
            gap = None
        out.append(("record", at, end - at, block))
        at = end
    return out + ([("gap", gap[0], len(data) - gap[0], gap[1])] if gap else [])


def found(data):
    return [(k, a, n, more[-1]) for k, a, n, *more in O.salvage(O.Source(Bytes(data)))]


@pytest.mark.parametrize("seed", range(12))
def test_salvage_equals_brute_force(seed):
    rng = random.Random(seed)
    parts = []
    for k in range(25):
        html = "".join(rng.choice(["<p>", "text ", "é", "\n", "WARC/1.1\r\n", "\x1f\x8b\x08"]) for _ in range(rng.randint(0, 60)))
        data = O.record(k, f"http://x/{k}", html)
        data = O.pack(data) if rng.random() < 0.6 else data
        parts.append(O.harmed(data, rng.choice([0, 0, 0, 1, 2, 3, 4, 5])))
    data = b"".join(parts)
    assert found(data) == brute(data)


def test_small_pieces(monkeypatch):
    data = b"".join(O.harmed(O.pack(O.record(k, None, "x" * 50 * k)) if k % 2 else O.record(k, None, "y\n" * 30 * k), k % 6) for k in range(30))
    want = found(data)
    monkeypatch.setattr(O, "CHUNK", 64)
    assert found(data) == want


def test_undamaged_archive_has_no_gap_and_all_blocks():
    data = b"".join(O.pack(O.record(k, "u", f"page {k}")) for k in range(20))
    assert [x[3] for x in found(data)] == [f"page {k}".encode() for k in range(20)]
    assert found(b"") == [] and found(b"stray") == [("gap", 0, 5, "no version line")]


def test_cut_file_and_each_damage_is_logged():
    whole = O.pack(O.record(1, "u", "a" * 500))
    assert found(whole + whole[:-5]) == [("record", 0, len(whole), b"a" * 500), ("gap", len(whole), len(whole) - 5, "member without end")]
    for kind in (1, 2, 3, 4):
        bad = O.harmed(O.record(2, "u", "line\n" * 99), kind)
        got = found(bad + whole)
        assert [(x[0], x[1]) for x in got] == [("gap", 0), ("record", len(bad))]


def warc(block, *fields, version="WARC/1.0"):
    return "\r\n".join([version, *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_headers_of_any_length_and_folded_fields():
    long = warc(b"x", "WARC-Type: response", "X-Long: " + "h" * 100_000, *[f"X-{k}: {k}" for k in range(20_000)])
    folded = warc(b"y", "WARC-Type:response", "X-Fold: a", "\t b", version="WARC/1.1")
    for pack in (bytes, O.pack):
        assert [x[-1] for x in found(pack(long) + pack(folded))] == [b"x", b"y"]
    *_, fields, _ = next(O.salvage(O.Source(Bytes(folded))))
    assert fields["x-fold"] == "a b"
    assert found(b"WARC/1.0\r\nno field\r\n\r\n" + long) == [("gap", 0, 22, "header without end"), ("record", 22, len(long), b"x")]
    assert found(b"WARC/1.0\r\nX: 1") == [("gap", 0, 14, "header without end")]


def test_member_of_several_records():
    parts = [warc(f"block {k}".encode() * 999 * k, f"WARC-Record-ID: <urn:page:{k}>") for k in range(6)]
    whole = O.pack(b"".join(parts))
    blocks = [f"block {k}".encode() * 999 * k for k in range(6)]
    assert found(whole) == [("record", 0, None, b) for b in blocks]
    after = O.pack(parts[1])
    assert found(b"junk" + whole + after) == [("gap", 0, 4, "no version line"), *[("record", 4, None, b) for b in blocks], ("record", 4 + len(whole), len(after), blocks[1])]
    bad = O.pack(b"".join(parts[:3]) + parts[3].replace(b"Content-Length: 2", b"Content-Length: 3", 1) + b"".join(parts[4:]))
    assert found(bad + after) == [*[("record", 0, None, b) for b in blocks[:3]], ("gap", 0, len(bad), "wrong content length"), ("record", len(bad), len(after), blocks[1])]
    assert found(whole[:-3]) == [*[("record", 0, None, b) for b in blocks], ("gap", 0, len(whole) - 3, "member without end")]


def test_foreign_archive(spark, tmp_path):
    latin, stray = warc("d\u00e9j\u00e0 vu".encode("latin-1"), "WARC-Target-URI: http://a/100%"), warc(b"ok \xe6\x97\xa5", "WARC-Target-URI: http://a/%zz+%20b")
    (tmp_path / "foreign.warc").write_bytes(latin + stray)
    (tmp_path / "whole.warc.gz").write_bytes(O.pack(latin + stray))
    got = O.salvaged_pages(O.list_warcs(spark, str(tmp_path))).collect()
    assert sorted((r["kind"], r["url"], r["html"]) for r in got) == sorted([("record", "http://a/100%", "d\ufffdj\ufffd vu"), ("record", "http://a/%zz+%20b", "ok \u65e5")] * 2)


def pages(spark):
    rows = [(k, f"http://h/{k}?q=a b+c%20", f"<p>{k} é日本 {'x' * (k * 37)}") for k in range(300)]
    rows += [(None, None, "no id"), (900, None, None), (901, "u", ""), (901, "u", ""), (902, "line\nbreak", "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as kind", "1 as block", "'f' as file")


def test_round_trip(spark):
    p = pages(spark).repartition(8)
    got = O.salvaged_pages(O.archive(p, O.S.fresh_path(spark, "warc")))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select("page_id", "url", "html").collect()), key=key) == sorted(map(tuple, p.select("page_id", "url", "html").collect()), key=key)
    assert got.where("kind = 'gap'").count() == 0


def test_damaged_archive_loses_the_damaged_alone(spark):
    p = pages(spark).repartition(8)
    got = O.salvaged_pages(O.archive(p, O.S.fresh_path(spark, "warc"), damage=True, roll=20_000))
    lost = {r["page_id"] for r in p.collect() if O.harm(r["page_id"]) in (1, 2, 3, 4)}
    assert lost
    assert sorted(str(r["page_id"]) for r in got.where("kind = 'record'").collect()) == sorted(str(r["page_id"]) for r in p.collect() if r["page_id"] not in lost)
    # gaps and records fill each file without overlap
    by = {}
    for r in got.collect():
        by.setdefault(r["file"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n


def test_empty_and_unreadable(spark):
    none = pages(spark).where("false")
    assert O.salvaged_pages(O.archive(none, O.S.fresh_path(spark, "warc"))).count() == 0
    got = O.read_warc(spark.createDataFrame([("/no/such/file.warc",), (None,)], "f string")).collect()
    assert [(r["kind"], r["length"]) for r in got] == [("gap", None)]
