"""JSON request source: absent key vs explicit null (D9), corrupt lines."""

import tempfile

from larder.operators import logistics
from larder.sources.requests import read_requests_json
from larder.sources.sinks import append_with_quarantine, conform, to_json_rows
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

STOCK_REQ = StructType([StructField(n, t) for n, t in [
    ("request_id", StringType()), ("location_id", StringType()), ("product_id", StringType()),
    ("status", StringType()), ("nearing_expiry", BooleanType())]])


def test_status_default_only_when_absent(spark):
    d = tempfile.mkdtemp(prefix="larder-req-")
    with open(f"{d}/req.json", "w") as fh:
        fh.write('{"request_id": "absent", "location_id": "L"}\n')
        fh.write('{"request_id": "null", "location_id": "L", "status": null}\n')
        fh.write('{"request_id": "given", "location_id": "L", "status": "Reserved"}\n')
        fh.write('not json at all\n')
    req = read_requests_json(spark, f"{d}/req.json", STOCK_REQ)
    assert req.filter("_corrupt_record is not null").count() == 1
    stock = spark.createDataFrame(
        [("s1", "p", "L", 1, None, None, None, "x", "Available"),
         ("s2", "p", "L", 1, None, None, None, "x", "Reserved")],
        "stock_id string, product_id string, location_id string, current_quantity_kg long, "
        "entry_date date, best_before_date date, expiry_date date, storage_conditions string, "
        "status string")
    got = {(r.request_id, r.stock_id) for r in
           logistics.warehouse_stock(req.filter("request_id is not null"), stock,
                                     "1998-06-15").collect()}
    assert got == {("absent", "s1"), ("given", "s2")}   # explicit null matches nothing


def test_required_fields_by_key_presence(spark):
    d = tempfile.mkdtemp(prefix="larder-req-")
    with open(f"{d}/req.json", "w") as fh:
        fh.write('{"request_id": "a", "farm_id": "f", "product_id": null, "quantity_kg": 1, '
                 '"requested_date": "2024-01-01"}\n')
        fh.write('{"request_id": "b", "farm_id": "f"}\n')
    schema = StructType([StructField(n, StringType()) for n in
                         ["request_id", "farm_id", "product_id", "quantity_kg", "requested_date"]])
    out = {r.request_id: r for r in
           logistics.pickup_intake(read_requests_json(spark, f"{d}/req.json", schema)).collect()}
    assert out["a"].status == "acknowledged"             # null but present counts as given
    assert out["b"].message.endswith("product_id, quantity_kg, requested_date")


def test_sinks_conform_and_quarantine(spark):
    d = tempfile.mkdtemp(prefix="larder-sink-")
    valid = spark.createDataFrame([("w1", "addr")], "warehouse_id string, location_address string")
    bad = spark.createDataFrame([("x", "e", "m")], "warehouse_id string, error_code string, "
                                                   "error_message string")
    append_with_quarantine(valid, bad, f"{d}/warehouses", "warehouses")
    assert spark.read.parquet(f"{d}/warehouses").count() == 1
    assert spark.read.parquet(f"{d}/warehouses_quarantine").count() == 1
    assert conform(valid.select("warehouse_id"), "warehouses").columns == \
        ["warehouse_id", "location_address"]
    js = to_json_rows(valid.withColumnRenamed("warehouse_id", "request_id")).collect()[0]
    assert js.json == '{"location_address":"addr"}'
