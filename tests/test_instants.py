from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.functions.instants import parse_instants
from loomgraph.functions.timezones import local_to_utc, transitions
from loomgraph.operators.instants import normalise_instants

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ZONES = ["Europe/Berlin", "America/New_York", "UTC", "Europe/London", "America/Los_Angeles", "Asia/Tokyo", "Asia/Kolkata", "Australia/Sydney", "America/St_Johns"]


def read(text, zone="UTC", order="DMY"):
    micros, ok = parse_instants([text], [zone], [order])
    return (EPOCH + timedelta(microseconds=int(micros[0]))).replace(tzinfo=None).isoformat() if ok[0] else None


@pytest.mark.parametrize(
    "text, zone, order, wanted",
    [
        ("2024-10-21 07:31:40", "Europe/Berlin", "DMY", "2024-10-21T05:31:40"),
        ("2020-12-25T11:14:26", "UTC", "DMY", "2020-12-25T11:14:26"),
        ("2023-03-07T06:06:04.003Z", "Asia/Tokyo", "DMY", "2023-03-07T06:06:04.003000"),
        ("20171227T192459Z", "Asia/Tokyo", "DMY", "2017-12-27T19:24:59"),
        ("05/04/2024", "UTC", "DMY", "2024-04-05T00:00:00"),
        ("05/04/2024", "UTC", "MDY", "2024-05-04T00:00:00"),
        ("25/04/2024", "UTC", "MDY", "2024-04-25T00:00:00"),
        ("05.04.2024 10:30", "UTC", "MDY", "2024-04-05T10:30:00"),
        ("2016", "Asia/Kolkata", "DMY", "2015-12-31T18:30:00"),
        ("2019-03", "UTC", "DMY", "2019-03-01T00:00:00"),
        ("February 2023", "UTC", "DMY", "2023-02-01T00:00:00"),
        ("3. Dezember 2015, 20:14 Uhr", "Europe/Berlin", "DMY", "2015-12-03T19:14:00"),
        ("19. März 2020", "UTC", "DMY", "2020-03-19T00:00:00"),
        ("Jun 22, 2022 12:32 AM", "UTC", "DMY", "2022-06-22T00:32:00"),
        ("Jun 22, 2022 12:32 p.m.", "UTC", "DMY", "2022-06-22T12:32:00"),
        ("18th of April 2023, 13:06", "UTC", "DMY", "2023-04-18T13:06:00"),
        ("Fri, 29 Sep 2023 20:33:07 +0100", "Asia/Tokyo", "DMY", "2023-09-29T19:33:07"),
        ("Tue Apr 11 09:44:36 2023", "UTC", "DMY", "2023-04-11T09:44:36"),
        ("16 Jan 2024, 05:55 UTC-03:30", "Asia/Tokyo", "DMY", "2024-01-16T09:25:00"),
        ("2024-07-25T04:49:15+05:30[Asia/Kolkata]", "UTC", "DMY", "2024-07-24T23:19:15"),
        ("2019-03-31 18:36:54 Asia/Kolkata", "UTC", "DMY", "2019-03-31T13:06:54"),
        ("2018-12-23 01:31 CET", "Asia/Tokyo", "DMY", "2018-12-23T00:31:00"),
        ("2015-12-01 10:30:40,9", "UTC", "DMY", "2015-12-01T10:30:40.900000"),
        ("1575408437.0", "Asia/Tokyo", "DMY", "2019-12-03T21:27:17"),
        ("1477650500000", "UTC", "DMY", "2016-10-28T10:28:20"),
        ("1452200915000000", "UTC", "DMY", "2016-01-07T21:08:35"),
        ("  2020-01-02\u00a0", "UTC", "DMY", "2020-01-02T00:00:00"),
        ("2023-03-26 02:30:00", "Europe/Berlin", "DMY", "2023-03-26T01:30:00"),  # skipped: the offset before
        ("2023-10-29 02:30:00", "Europe/Berlin", "DMY", "2023-10-29T00:30:00"),  # twice: the first
    ],
)
def test_forms(text, zone, order, wanted):
    assert read(text, zone, order) == wanted


@pytest.mark.parametrize("text", [None, "", " ", "soon", "null", "n/a", "Q5 2023", "2024-13-40", "0000-00-00", "31/31/2021", "2023-02-29", "12345", "20171227", "2020-01-01 25:00", "x" * 100_000, "9" * 5000])
def test_no_instant(text):
    assert read(text) is None


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(2001, 1, 1), datetime(2037, 1, 1)), st.sampled_from(ZONES))
def test_zone_tables_agree_with_the_zone_database(local, zone):
    local = local.replace(microsecond=0)
    wanted = int((local.replace(tzinfo=ZoneInfo(zone)) - EPOCH).total_seconds())
    seconds = np.array([int((local.replace(tzinfo=timezone.utc) - EPOCH).total_seconds())])
    assert local_to_utc(seconds, zone)[0][0] == wanted
    assert read(local.strftime("%d %b %Y, %H:%M:%S"), zone) == datetime.fromtimestamp(wanted, timezone.utc).replace(tzinfo=None).isoformat()


def test_unknown_zone():
    assert transitions("No/Where") is None
    assert read("2020-01-02 10:00:00 No/Where") is None


def test_operator(spark):
    edges = spark.createDataFrame(
        [("a", "g", "2020-01-01 00:00:00", "soon", "x"), ("a", "g", "2020-01-01 00:00:00", "soon", "y"), ("b", "none", "2020", None, "z"), (None, "g", "2020", "2020", "q"), ("c", None, "2021", "", "w")],
        "uuid string, group_id string, valid_at string, invalid_at string, time_zone string",
    )
    zones = spark.createDataFrame([("g", "Asia/Tokyo", "DMY", "u"), (None, "UTC", "DMY", "u")], "group_id string, time_zone string, date_order string, uuid string")
    found = {(r.uuid, r.field): r.utc_micros for r in normalise_instants(edges, zones).collect()}
    assert found == {("a", "valid_at"): 1577804400000000, ("b", "valid_at"): 1577836800000000, ("c", "valid_at"): 1609459200000000}
    assert normalise_instants(edges.limit(0), zones).count() == 0
    assert normalise_instants(edges, zones.limit(0)).count() == 3


def test_long_texts_that_a_form_matches():
    texts = ["Wednesday, 12 September 2018 at 10:15:30.123456 -03:00 [America/Argentina/Buenos_Aires]", "9" * 200, "a 9 " * 50_000, "x" * 100_000 + "9"]
    micros, ok = parse_instants(texts, [None] * 4, [None] * 4)
    assert ok.tolist() == [True, False, False, False] and micros[0] == int(datetime(2018, 9, 12, 13, 15, 30, tzinfo=timezone.utc).timestamp()) * 1_000_000 + 123_456
