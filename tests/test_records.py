"""Record files: text by line, packed by length, bad bytes, corpus directories."""

import datetime as dt
from decimal import Decimal as D

import pytest

from claimweave.sources import layouts
from claimweave.sources.corpus import read_corpus
from claimweave.sources.layouts import Layout
from claimweave.sources.record_files import list_files, read_packed, read_records, write_records
from claimweave.sources.records import decode_records, encode_records, read_fixed

PAIR = Layout.of(("id", "9(3)"), ("amount", "9(7)V9(2) packed"))


def bytes_of(id, amount):
    return id.encode() + bytes.fromhex(amount)


@pytest.mark.parametrize("layout, length", [
    (layouts.CLAIM, 85), (layouts.SCREENING_MEMBER, 84), (layouts.SCREENING_CLAIM, 47),
    (layouts.CHURN_MEMBER, 134), (layouts.RISK_MEMBER, 74), (layouts.DIAGNOSIS, 34),
    (layouts.PROVIDER, 123), (layouts.PROVIDER_CLAIM, 61), (layouts.PRIOR_AUTH, 86),
])
def test_packed_lengths(layout, length):
    assert layout.length(packed=True) == length


def test_offsets():
    assert [(f.name, at) for f, at in layouts.CHURN_MEMBER.slots(True)][-3:] == [
        ("premium_amount", 118), ("claims_last_year", 123), ("total_cost_last_yr", 128)]


def test_packed_bytes_that_look_like_line_ends(spark, tmp_path):
    rows = [
        bytes_of("001", "012345678C"), bytes_of("002", "000000000D"), bytes_of("003", "000000000F"),
        bytes_of("004", "000000000A"), bytes_of("005", "100000012D"), bytes_of("006", "0A0000000C"),
        bytes_of("00X", "000000000C"),
    ]
    (tmp_path / "a.dat").write_bytes(b"".join(rows))
    got = [tuple(r) for r in read_packed(spark, str(tmp_path / "a.dat"), PAIR, bad="bad").collect()]
    assert got == [
        (1, D("123456.78"), []), (2, D("0.00"), []), (3, D("0.00"), []), (4, D("0.00"), []),
        (5, D("-1000000.12"), []), (6, None, ["amount"]), (None, D("0.00"), ["id"]),
    ]


def test_record_delimiters_and_partial_records(spark, tmp_path):
    (tmp_path / "b.dat").write_bytes(b"\n".join([bytes_of("001", "000000100C"), bytes_of("002", "000000200C")]) + b"\n")
    got = read_packed(spark, str(tmp_path / "b.dat"), PAIR, trailer=1).collect()
    assert [tuple(r) for r in got] == [(1, D("1.00")), (2, D("2.00"))]
    with pytest.raises(ValueError, match="whole number of 8-byte records"):
        read_packed(spark, str(tmp_path / "b.dat"), PAIR)


def test_records_split_over_many_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.dat").write_bytes(
            b"".join(bytes_of(f"{i:03}", f"{i:09}C") for i in range(k * 100, k * 100 + 100)))
    df = read_packed(spark, str(tmp_path), PAIR)
    assert df.count() == 500
    assert df.selectExpr("sum(amount)").first()[0] == D(sum(range(500))) / 100


def test_fixed_lines(spark, tmp_path):
    line = "0000000001" + "ANA".ljust(20) + "L\xd3PEZ".ljust(30) + "19600229" + "F" + "064" + "ACTIVE".ljust(10) + "12"
    short = "0000000002" + "BO".ljust(20) + "X".ljust(30) + "00000000" + "M" + "06A" + "ACTIVE"
    wrong_day = line.replace("19600229", "19610229")
    (tmp_path / "m.dat").write_bytes("\r\n".join([line, short, wrong_day]).encode("latin-1"))
    got = read_fixed(spark, str(tmp_path / "m.dat"), layouts.SCREENING_MEMBER, bad="bad").collect()
    assert tuple(got[0]) == (1, "ANA", "L\xd3PEZ", dt.date(1960, 2, 29), "F", 64, "ACTIVE", 12, [])
    assert tuple(got[1]) == (2, "BO", "X", None, "M", None, "ACTIVE", None, ["age", "enrollment_months"])
    assert (got[2].date_of_birth, got[2].bad) == (None, ["date_of_birth"])


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, packed):
    rows = [(1, "HCC17", dt.date(2023, 5, 6), D("0.3180")), (2, "", None, D("9.9999")), (3, "A B", dt.date(1999, 1, 1), D("0.0000"))]
    schema = "member_id long, hcc_code string, service_date date, hcc_weight decimal(5,4)"
    df = spark.createDataFrame(rows, schema).selectExpr("member_id", "'E11.9' diagnosis_code", "hcc_code", "service_date", "hcc_weight")
    encoded = encode_records(df, layouts.DIAGNOSIS, packed)
    assert {len(r.record) for r in encoded.collect()} == {layouts.DIAGNOSIS.length(packed)}
    back = decode_records(encoded, "record", layouts.DIAGNOSIS, packed)
    assert back.schema == layouts.DIAGNOSIS.schema
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("piece, value", [
    ("00042", 42), ("-0042", None), ("+0042", None), (" 0042", None), ("0042 ", None), ("0042\t", None), ("1E003", None),
    ("00.42", None), ("0042", None), ("", None), ("0004A", None), ("99999", 99999), (":0042", None), ("\u0661\u0662", None),
])
def test_numbers_are_digits_only(spark, piece, value):
    layout = Layout.of(("n", "9(5)"))
    df = spark.createDataFrame([(bytearray(piece.encode()),)], "record binary")
    row = decode_records(df, "record", layout, packed=False, bad="bad").first()
    assert (row.n, row.bad) == (value, [] if value is not None else ["n"])


@pytest.mark.parametrize("piece", ["2023011 ", " 2023011", "2023011T", "20230230", "20231301", "2023 101", "abcdefgh"])
def test_malformed_dates(spark, piece):
    df = spark.createDataFrame([(bytearray(piece.encode()),)], "record binary")
    row = decode_records(df, "record", Layout.of(("d", "9(8) date")), packed=False, bad="bad").first()
    assert (row.d, row.bad) == (None, ["d"])


def test_unknown_picture():
    with pytest.raises(ValueError, match="unsupported picture"):
        Layout.of(("x", "Z(3)"))


def test_corpus_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.cbl").write_bytes(b"IDENTIFICATION DIVISION.")
    (tmp_path / "sub" / "b.COBOL").write_bytes("caf\xe9 €".encode())
    (tmp_path / "c.Cob").write_bytes(b"caf\xe9")
    (tmp_path / "d.txt").write_bytes(b"no")
    (tmp_path / "e.xcbl").write_bytes(b"no")
    got = {r.filename: (r.text, r.size_bytes) for r in read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.cbl": ("IDENTIFICATION DIVISION.", 24), "b.COBOL": ("caf\xe9 €", 9), "c.Cob": ("caf\xe9", 4)}


FIELDS = Layout.of(("n", "9(3)"), ("t", "X(4)"), ("d", "9(8) date"), ("m", "9(2)V9(1) packed"))


@pytest.mark.parametrize("packed", [True, False])
def test_nulls_stay_in_their_field(spark, packed):
    schema = "n int, t string, d date, m decimal(3,1)"
    rows = [(None, "ab", dt.date(2020, 1, 2), D("1.5")), (7, None, None, None), (0, "", None, D("0.0"))]
    encoded = encode_records(spark.createDataFrame(rows, schema), FIELDS, packed)
    back = decode_records(encoded, "record", FIELDS, packed, bad="bad").collect()
    assert sorted(map(str, back)) == sorted(map(str, [
        type(back[0])(n=None, t="ab", d=dt.date(2020, 1, 2), m=D("1.5"), bad=["n"]),
        type(back[0])(n=7, t="", d=None, m=None, bad=["m"]), type(back[0])(n=0, t="", d=None, m=D("0.0"), bad=[])]))


@pytest.mark.parametrize("packed, row", [
    (True, (1000, "a", D("1.0"))), (False, (-7, "a", D("1.0"))), (True, (1, "abcde", D("1.0"))), (True, (1, "\u4f60", D("1.0"))),
    (True, (1, "a", D("100.0"))), (True, (1, "a", D("1.55"))), (False, (1, "a", D("-1.5"))),
])
def test_values_that_do_not_fit_raise(spark, packed, row):
    df = spark.createDataFrame([(row[0], row[1], None, row[2])], "n int, t string, d date, m decimal(9,2)")
    with pytest.raises(Exception, match="does not hold|MALFORMED_CHARACTER_CODING"):
        encode_records(df, FIELDS, packed).collect()


def test_packed_keeps_the_sign(spark):
    df = spark.createDataFrame([(1, "a", None, D("-1.5"))], "n int, t string, d date, m decimal(3,1)")
    assert decode_records(encode_records(df, FIELDS, True), "record", FIELDS, True).first().m == D("-1.5")


@pytest.mark.parametrize("packed, delimiter", [(True, b""), (True, b"\r\n"), (False, b"\n")])
def test_files_are_read_back_in_ranges(spark, tmp_path, packed, delimiter):
    path, rows = str(tmp_path / "out"), [(i % 1000, D(i) / 100) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, amount decimal(9,2)").repartition(3)
    write_records(df, path, PAIR, packed, delimiter)
    assert len(list_files(path)) == 3
    back = read_records(spark, path, PAIR, packed, delimiter, range_bytes=1000)
    assert back.rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    write_records(df.limit(5), path, PAIR, packed, delimiter, mode="append")
    assert read_records(spark, path, PAIR, packed, delimiter).count() == 3005
    write_records(df.limit(7), path, PAIR, packed, delimiter)
    assert read_records(spark, path, PAIR, packed, delimiter).count() == 7
    write_records(df.limit(0), path, PAIR, packed, delimiter)
    assert read_records(spark, path, PAIR, packed, delimiter).count() == 0


def test_a_failing_write_leaves_the_old_files(spark, tmp_path):
    path = str(tmp_path / "out")
    write_records(spark.createDataFrame([(1, D("1.00"))], "id int, amount decimal(9,2)"), path, PAIR, True)
    before = list_files(path)
    # The last row does not fit its field; other tasks have written by then.
    bad = spark.range(400).selectExpr("cast(if(id = 399, 5000, id) as int) id", "cast(1 as decimal(9,2)) amount").repartition(8)
    with pytest.raises(Exception, match="does not hold"):
        write_records(bad, path, PAIR, True)
    assert list_files(path) == before and sorted(p.name for p in (tmp_path / "out").iterdir()) == [before[0][0].rsplit("/", 1)[1]]


def test_a_wrong_delimiter_and_a_missing_path_raise(spark, tmp_path):
    (tmp_path / "d.dat").write_bytes(bytes_of("001", "000000100C") + b"\n" + bytes_of("002", "000000200C") + b";")
    with pytest.raises(Exception, match="no delimiter .* after the record at byte 9"):
        read_records(spark, str(tmp_path / "d.dat"), PAIR, True, b"\n").collect()
    with pytest.raises(FileNotFoundError):
        read_records(spark, str(tmp_path / "nothing"), PAIR, True)
