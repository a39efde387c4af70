import pytest

from rowlens.model import Dialect, Format
from rowlens.sources.sniff import detect_format, encoding_of, json_shape, read_head, sniff_dialect

OBJECTS = b'{"river": "Elbe", "km": 1094}\n{"river": "Oder", "km": 840}\n'


@pytest.mark.parametrize(
    ("name", "content", "expected"),
    [
        ("rivers.parquet", b"", Format.PARQUET),
        ("rivers.Pqt", b"", Format.PARQUET),
        ("rivers.NDJSON", b"", Format.JSON_LINES),
        ("rivers.jsonl", b"", Format.JSON_LINES),
        ("rivers.tsv", b"", Format.DELIMITED),
        ("rivers", b"", Format.DELIMITED),
        ("rivers.txt", OBJECTS, Format.JSON_LINES),
        ("rivers.tsv", b"[1094, 840, 1233]\n", Format.JSON_ARRAY),
        ("rivers.jsonl", b"river;km\nElbe;1094\n", Format.JSON_LINES),
        ("rivers.json", b"river;km\nElbe;1094\n", Format.DELIMITED),
        ("rivers.json", b"[km]\triver\n1094\tElbe\n", Format.DELIMITED),
        ("rivers.csv", b"PAR1\x15\x04rest", Format.PARQUET),
        ("rivers.dat", b"Elbe|1094\n", Format.DELIMITED),
        ("rivers.dat", OBJECTS.decode().encode("utf-16"), Format.JSON_LINES),
    ],
)
def test_detect_format(spark, tmp_path, name, content, expected):
    (tmp_path / name).write_bytes(content)
    assert detect_format(spark, str(tmp_path / name)) is expected


def test_head_is_bounded_and_missing_files_are_empty(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"x" * 100_000)
    assert len(read_head(spark, str(tmp_path / "big"))) == 64 * 1024
    assert read_head(spark, str(tmp_path / "none")) == b""


@pytest.mark.parametrize(
    ("head", "expected"),
    [
        (OBJECTS, Format.JSON_LINES),
        (b"\n\n\t{}\n", Format.JSON_LINES),
        (b'\t["Elbe"', Format.JSON_ARRAY),
        (b"\xef\xbb\xbf\n[[1], [2]]", Format.JSON_ARRAY),
        (b"[\n\n", Format.JSON_ARRAY),
        (b"[river]\tkm", None),
        (b'{\n "river": "Elbe"\n}', None),
        (b"Elbe\t1094", None),
        (b"  \n", None),
    ],
)
def test_json_shape(head, expected):
    assert json_shape(head) is expected


@pytest.mark.parametrize(
    ("head", "expected"),
    [
        (b"river,sea\nElbe,North\n", Dialect(",")),
        (b"river\tsea\nElbe\tNorth\n", Dialect("\t")),
        (b"river;sea;km\nElbe;North;1094\n", Dialect(";")),
        (b"river|km\nElbe|1094\n", Dialect("|")),
        (b"1094,840\n1233,524\n", Dialect(",", '"', False)),
        (b"", Dialect()),
        (b"Elbe\nOder\n", Dialect()),
        (b"river,sea;km\nElbe,North;1\n", Dialect(",")),
        (b'"river\nname",km\nElbe,1094\n', Dialect(",")),
        ("﻿1094;840\n1233;524\n".encode("utf-16-le"), Dialect(";", '"', False)),
    ],
)
def test_dialect(head, expected):
    assert sniff_dialect(head) == expected


def test_encodings():
    assert encoding_of("﻿Oder".encode("utf-16-be")) == ("utf-16-be", b"Oder")
    assert encoding_of(b"\xef\xbb\xbfOder") == ("utf-8", b"Oder")
    assert encoding_of(b"Oder") == ("utf-8", b"Oder")
