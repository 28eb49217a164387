"""Hand cases of landing: ids of any text, the newest response, the ends of a page walk, payloads that land twice."""

import hashlib
import json
import shutil

from pyspark.sql import functions as F

from tracewright.functions.normalize import json_text
from tracewright.sources import ingest


def test_json_text_equals_ascii_json(spark):
    texts = ["plain", "", 'a"b\\c', "é", "tab\tline\nfeed\fback\breturn\r", "\x01\x1f\x7f", "😀 and 漢字", "$1 \\u0041", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_text(F.col("t")).alias("j")).collect()
    assert {r["i"]: r["j"] for r in rows} == {i: json.dumps(t) for i, t in enumerate(texts)}


def test_only_the_newest_response_counts(spark):
    log = [("a", "x", 200, 900, 0, 1), ("a", "x", 500, 950, 0, 2), ("a", "y", 200, 10, 0, 3), ("a", "z", 200, 10, 5, 4), ("b", "x", 500, 900, 0, 5), ("b", "x", 200, 950, 0, 6)]
    df = spark.createDataFrame(log, "endpoint string, request string, status int, fetched_at long, cursor long, response_id long")
    assert sorted(r["response_id"] for r in ingest.latest_valid(df, 1000, 100).collect()) == [4, 6]


def test_page_walk_ends(spark):
    schema = "wallet string, chain string, id string, idx int, ts long"
    rows = [("reached", "c", "1", 0, 50), ("open", "c", "1", 0, 200), ("open", "c", "1", 0, 200), ("open", "c", "2", 0, 0), ("timeless", "c", "1", 0, 0), ("stuck", "c", "1", 0, 300)]
    before = spark.createDataFrame([("open", "c", 300), ("timeless", "c", 400), ("stuck", "c", 300)], "wallet string, chain string, cursor long")
    df = spark.createDataFrame(rows, schema)
    got = {r["wallet"]: (r["n_rows"], r["cursor"], r["complete"]) for r in ingest.page_cursors(df, 100, before).collect()}
    assert got == {"reached": (1, 50, True), "open": (2, 200, False), "timeless": (1, 400, True), "stuck": (1, 300, True)}
    assert {r["wallet"]: r["complete"] for r in ingest.page_cursors(df, 100).collect()} == {"reached": True, "open": False, "timeless": True, "stuck": False}


def test_a_payload_lands_once(spark, tmp_path):
    raw = spark.createDataFrame([("p", 1, "one"), ("p", 1, "one"), ("p", 2, "two")], "provider string, day long, payload string")
    path = str(tmp_path / "archive")
    ingest.write_archive(raw.where("day = 1"), path)
    ingest.write_archive(raw, path)
    ingest.write_archive(raw, path)
    back = ingest.read_archive(spark, path, "payload string, provider string, day long").collect()
    assert sorted((r["payload"], r["day"]) for r in back) == [("one", 1), ("two", 2)]


def test_a_landing_reads_its_own_part_of_the_digests(spark, tmp_path):
    path = str(tmp_path / "archive")
    schema = "provider string, day long, payload string"
    ingest.write_archive(spark.createDataFrame([("p", k % 3, f"payload {k}") for k in range(300)], schema), path)
    parts = {p.name for p in (tmp_path / "archive_digests").iterdir() if p.is_dir()}
    assert len(parts) > 100
    # Digests of other prefixes are not opened: spoiling their files goes unnoticed.
    one = spark.createDataFrame([("p", 0, "payload 7"), ("p", 0, "new")], schema)
    own = {f"prefix={r[0]}" for r in one.select(F.substring(F.sha2("payload", 256), 1, 2)).collect()}
    for name in parts - own:
        for f in (tmp_path / "archive_digests" / name).glob("*.parquet"):
            f.write_bytes(b"spoiled")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    ingest.write_archive(one, path)
    assert ingest.read_archive(spark, path, schema).count() == 301


def test_a_landing_cut_off_before_its_digests_lands_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    raw = spark.createDataFrame([("p", 1, "one"), ("q", 2, "two")], "provider string, day long, payload string")
    ingest.write_archive(raw, path)
    shutil.rmtree(tmp_path / "archive_digests")
    ingest.write_archive(raw, path)
    assert sorted(r.payload for r in ingest.read_archive(spark, path, "payload string, provider string, day long").collect()) == ["one", "two"]


def test_history_rows_become_events(spark):
    """A payment to an exchange is evidence, not a sale; of equal legs the first counts; what is no number counts as nothing."""
    row = {"id": "0x1", "idx": 0, "time_at": 1000, "cex_id": "binance", "sends": [{"amount": 2, "price": 100, "to_addr": "0xcex", "token_id": "0xToken"}], "receives": [], "tx": {"from_addr": "0xwallet", "to_addr": "0xcex", "id": "0x1"}}
    stable = {"id": "", "idx": 1, "time_at": "2000.9", "project_id": "p", "cate_id": "c", "sends": [{"amount": 9, "price": 100, "token_id": "0xDAC17F958D2ee523a2206206994597c13d831ec7"}], "receives": [{"amount": 3, "price": 2, "token_id": "eth"}, {"amount": 6, "price": 1, "token_id": "0xLater"}], "tx": {"id": "0x2"}}
    bare = {"id": "0x3", "idx": None, "time_at": 5, "token_approve": "x", "sends": None, "receives": [{"amount": "bad", "price": 1, "token_id": "t"}]}
    gone = {"id": "0x4", "time_at": "never"}
    page = {"history_list": [row, stable, bare, gone], "cex_dict": {"binance": {"name": "Binance"}}, "cate_dict": {"c": {"name": "Cat"}}, "project_dict": {"p": {"name": "Project"}}}
    df = spark.createDataFrame([("ent", "0xWallet", "eth", json.dumps(page))], "entity_id string, wallet string, chain string, payload string")
    got = {r.event_index: r for r in ingest.normalize_pages(df).collect()}
    one, two, three = got[0], got[1], got[None]
    assert len(got) == 3 and (one.action_type, one.usd_value, one.cex_name, one.wallet, one.tx_hash) == ("CEX_INTERACTION_OUT", 200, "Binance", "0xwallet", "0x1")
    assert (one.primary_token_id, one.primary_asset_key, one.primary_direction) == ("0xToken", "ethereum:0xtoken", "send")
    # Of equal legs the first, stable ones never; the id of the transaction where the row has none.
    assert (two.action_type, two.usd_value, two.primary_token_id, two.primary_asset_key, two.tx_hash, two.ts) == ("DEFI_INTERACTION_BIDIRECTIONAL", 900, "eth", "coingecko:ethereum", "0x2", 2000)
    assert (two.cate_name, two.project_name, two.cex_name) == ("Cat", "Project", None)
    assert (three.action_type, three.usd_value, three.primary_token_id) == ("APPROVAL", 0, None)
    assert one.event_id == hashlib.sha256(json.dumps(["ent", "0xwallet", "eth", "0x1", 0, 1000], separators=(",", ":")).encode()).hexdigest()
