"""The ledgered store: one commit over four tables, keyed upsert, aligned key checks, line ids, year pruning."""

import os
import uuid

import pytest

from conftest import SF001
from salescope.operators import clean, quality, rank, rollup
from salescope.operators import star as starops
from salescope.operators.numbering import dense_numbers
from salescope.plans import etl, store
from salescope.plans.catalog import P_COUNTRY, P_YEAR
from salescope.sources.testdata import raw_batches_from_testdata, raw_feed_from_testdata


def same(a, b):
    a = a.select(b.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def files_below(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def forget(spark, prefix):
    for name in ("countries", "products", "invoices", "invoice_lines"):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A store with two batches; path and prefix."""
    path, prefix = str(tmp_path_factory.mktemp("store")), "st" + uuid.uuid4().hex[:8]
    for raw in raw_batches_from_testdata(spark, SF001):
        store.load_batch(raw, path, prefix, n_buckets=4)
    return path, prefix


def test_two_batches_are_what_one_load_gives(spark, loaded):
    path, prefix = loaded
    first, second = raw_batches_from_testdata(spark, SF001)
    one = etl.run_etl(first).star
    want = etl.run_etl(second, one).star
    forget(spark, prefix)  # another session knows the folder alone
    got = store.open_star(spark, path, prefix)
    for name in ("countries", "products", "invoices", "invoice_lines"):
        assert same(got.tables()[name], want.tables()[name]), name
    assert same(store.open_star(spark, path, prefix, upto=1).products, one.products)
    assert sorted(r[0] for r in got.lines.select("line_id").collect()) == list(range(1, got.lines.count() + 1))
    first_ids = store.open_star(spark, path, prefix, upto=1).lines.agg({"line_id": "max"}).first()[0]
    assert first_ids == store.commits(spark, path)[0].last_line_id < store.commits(spark, path)[1].last_line_id
    assert all(r["n_duplicate_keys"] == 0 for r in quality.check_primary_keys(got).collect())
    assert all(r["n_orphans"] == 0 for r in quality.check_foreign_keys(got).collect())


@pytest.mark.parametrize("broken", ["countries", "products", "invoices", "invoice_lines", "ledger"])
def test_a_load_that_ends_between_writes_leaves_the_old_state(spark, scratch, monkeypatch, broken):
    raw = raw_feed_from_testdata(spark, SF001)
    small, more = raw.filter("file_name = 'feed_0.csv'"), raw.filter("file_name = 'feed_1.csv'")
    prefix = "br" + uuid.uuid4().hex[:8]
    store.load_batch(small, scratch, prefix, n_buckets=2)
    before = {n: df.collect() for n, df in store.open_star(spark, scratch, prefix).tables().items()}
    write, commit = store._append, store._commit

    def failing(rows, table):
        write(rows, table)
        if table.endswith(broken):
            raise RuntimeError("the driver is lost")

    def not_committed(*args):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(store, "_append", failing)
    monkeypatch.setattr(store, "_commit", not_committed)
    with pytest.raises(RuntimeError):
        store.load_batch(more, scratch, prefix)
    forget(spark, prefix)
    after = store.open_star(spark, scratch, prefix)
    assert all(sorted(map(str, df.collect())) == sorted(map(str, before[n])) for n, df in after.tables().items())
    # the same batch again goes in whole, beside what the failed load left
    monkeypatch.setattr(store, "_append", write)
    monkeypatch.setattr(store, "_commit", commit)
    got = store.load_batch(more, scratch, prefix).star
    want = etl.run_etl(more, etl.run_etl(small).star).star
    assert all(same(got.tables()[n], want.tables()[n]) for n in before)
    assert [c.batch for c in store.commits(spark, scratch)] == [1, 3]


def test_the_second_of_two_loads_from_one_state_is_refused(spark, scratch, monkeypatch):
    raw = raw_feed_from_testdata(spark, SF001).filter("file_name = 'feed_0.csv'")
    prefix = "cc" + uuid.uuid4().hex[:8]
    begin = store._begin

    def overtaken(sp, path):
        monkeypatch.setattr(store, "_begin", begin)
        store.load_batch(raw, path, prefix, n_buckets=2)
        return begin(sp, path)

    monkeypatch.setattr(store, "_begin", overtaken)
    with pytest.raises(store.ConcurrentLoad):
        store.load_batch(raw, scratch, prefix, n_buckets=2)
    assert len(store.commits(spark, scratch)) == 1
    assert store.open_star(spark, scratch, prefix).lines.count() == etl.run_etl(raw).star.lines.count()


def test_untouched_product_buckets_keep_their_files(spark, scratch):
    raw = raw_feed_from_testdata(spark, SF001).filter("file_name = 'feed_0.csv'")
    prefix = "pb" + uuid.uuid4().hex[:8]
    star = store.load_batch(raw, scratch, prefix, n_buckets=2).star
    row = star.products.orderBy("product_code").first()
    line = raw.filter("upper(StockCode) = '" + row["product_code"] + "' AND Description IS NOT NULL AND Quantity > 0").limit(1)
    renamed = line.selectExpr("'feed_9.csv' AS file_name", "row_pos", "'900001' AS InvoiceNo", "StockCode", "'ANOTHER NAME' AS Description",
                              "'3' AS Quantity", "'12/1/2010 8:26' AS InvoiceDate", "UnitPrice", "CustomerID", "'France' AS Country")
    before = files_below(f"{scratch}/products")
    got = store.load_batch(renamed, scratch, prefix).star
    last = store.commits(spark, scratch)[-1]
    assert last.product_buckets == [row["bucket"]] and last.n_products == 1 and last.n_lines == 1
    added = set(files_below(f"{scratch}/products")) - set(before)
    assert added and all(f"/bucket={row['bucket']}/" in f for f in added)
    assert {f: t for f, t in files_below(f"{scratch}/products").items() if f in before} == before
    names = {r["product_code"]: r["product_name"] for r in got.products.collect()}
    assert names == {**{r["product_code"]: r["product_name"] for r in star.products.collect()}, row["product_code"]: "ANOTHER NAME"}
    # nothing new: no bucket is written
    store.load_batch(renamed, scratch, prefix)
    assert store.commits(spark, scratch)[-1].product_buckets == [] and store.commits(spark, scratch)[-1].n_lines == 0


def test_strict_batches(spark, scratch):
    raw = raw_feed_from_testdata(spark, SF001)
    prefix = "sr" + uuid.uuid4().hex[:8]
    store.load_batch(raw.filter("file_name <= 'feed_1.csv'"), scratch, prefix, n_buckets=2, mode="strict")
    again = store.load_batch(raw.filter("file_name >= 'feed_1.csv'"), scratch, prefix, mode="strict")
    refused = {r["file_name"] for r in again.verdict.collect() if not r["lines_accepted"]}
    assert refused == {"feed_1.csv"}
    want = etl.run_etl(raw.filter("file_name >= 'feed_1.csv'"), etl.run_etl(raw.filter("file_name <= 'feed_1.csv'"), mode="strict").star, mode="strict").star
    assert same(again.star.lines, want.lines) and same(again.star.invoices, want.invoices)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_lines_are_not_shuffled_by_a_load(spark, loaded):
    path, prefix = loaded
    old = store.open_star(spark, path, prefix)
    rows = clean.clean(raw_feed_from_testdata(spark, SF001)).checkpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with store._aligned(spark):
            added = store.new_invoices(old.invoices, starops.star_invoices(rows), 4)
            lines = store.new_lines(old, starops.star_invoice_lines(rows), added.checkpoint(), old.products, 4)
            for df, table in ((added, "invoices"), (lines, "invoice_lines")):
                plan = _plan(df).split("== Initial Plan ==")[-1].splitlines()
                scans = [i for i, line in enumerate(plan) if "FileScan parquet" in line and f"{prefix}_{table}" in line]
                assert scans and all("Bucketed: true" in plan[i] and "GreaterThanOrEqual(invoice_no" in plan[i] for i in scans), plan
                for i in scans:
                    # from the scan up to the join it feeds there is no exchange
                    depth = plan[i].index("FileScan")
                    for above in reversed(plan[:i]):
                        at = len(above) - len(above.lstrip(" :+-*(0123456789)"))
                        if at < depth:
                            depth = at
                            assert "Exchange" not in above, (table, above)
                            if "Join" in above:
                                break
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_year_reads_its_partition_alone(spark, loaded):
    path, prefix = loaded
    star = store.open_star(spark, path, prefix)
    once = etl.run_etl(raw_feed_from_testdata(spark, SF001)).star
    pairs = [(rank.rank_countries(s, "all", P_YEAR), rank.rank_products(s, "top", P_YEAR), rank.country_top_products(s, P_COUNTRY, P_YEAR),
              rank.product_top_countries(s, "00006A", P_YEAR)) for s in (star, once)]
    for got, _ in zip(*pairs):
        scans = [line for line in _plan(got).splitlines() if "FileScan parquet" in line and f"{prefix}_invoice" in line]
        assert scans and all("PartitionFilters: [" in s and f"(invoice_year" in s.split("PartitionFilters")[1] for s in scans), scans
    assert pairs[0][0].collect() == pairs[1][0].collect()  # no product name in it


def test_a_store_with_an_outsized_bucket(spark, scratch):
    raw = raw_feed_from_testdata(spark, SF001)
    one = raw.filter("file_name = 'feed_0.csv'")
    hot = one.selectExpr("'hot.csv' AS file_name", "row_pos", "'777777' AS InvoiceNo", "StockCode", "Description", "Quantity", "'12/1/2010 8:26' AS InvoiceDate",
                         "UnitPrice", "CustomerID", "'France' AS Country")
    prefix = "hb" + uuid.uuid4().hex[:8]
    store.load_batch(hot.unionByName(raw.filter("file_name = 'feed_1.csv'").limit(40)), scratch, prefix, n_buckets=8)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert etl.bucket_skewed(spark, f"{scratch}/invoice_lines", 2.0)
        skewed, store.bucket_skewed = store.bucket_skewed, lambda sp, at: True
        star = store.open_star(spark, scratch, prefix)
        assert "Bucketed: true" not in _plan(rank.rank_countries(star, "all"))
        got = store.load_batch(raw.unionByName(hot), scratch, prefix).star
    finally:
        store.bucket_skewed = skewed
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = etl.run_etl(hot.unionByName(raw)).star
    assert all(same(got.tables()[n], want.tables()[n]) for n in ("countries", "invoices", "invoice_lines"))


@pytest.mark.parametrize("upto", [1, 2])
def test_all_rankings_from_the_rollup(spark, loaded, upto):
    star, cubes = store.open_star(spark, *loaded, upto=upto), store.open_rollup(spark, *loaded, upto=upto)
    code = star.lines.groupBy("product_code").count().orderBy("count", ascending=False).first()[0]
    names = star.products
    pairs = []
    for year in (None, P_YEAR):
        for mode in ("top", "all", "flop"):
            pairs += [(rank.rank_countries(star, mode, year), rollup.rank_countries(cubes, mode, year)),
                      (rank.rank_products(star, mode, year), rollup.rank_products(cubes, names, mode, year))]
        pairs += [(rank.country_top_products(star, P_COUNTRY, year), rollup.country_top_products(cubes, names, P_COUNTRY, year)),
                  (rank.product_top_countries(star, code, year), rollup.product_top_countries(cubes, code, year))]
    pairs.append((rank.rank_products_by_name(star, P_YEAR), rollup.rank_products_by_name(cubes, names, P_YEAR)))
    assert len(pairs) == 17
    for direct, kept in pairs:
        assert kept.columns == direct.columns and kept.collect() == direct.collect() != []
        plan = _plan(kept)
        assert "_rollup[" in plan and "_invoices[" not in plan and "_invoice_lines[" not in plan


def test_rollup_reads_one_level(spark, loaded):
    plan = _plan(rollup.rank_countries(store.open_rollup(spark, *loaded), "top", P_YEAR))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert f"(level#" in scan.split("PartitionFilters")[1] and f"level={rollup.level_of('invoice_year', 'country')}" in scan


def test_a_prefix_of_another_folder_is_refused(spark, loaded, scratch):
    _, prefix = loaded
    with pytest.raises(ValueError, match="another prefix"):
        store.load_batch(raw_feed_from_testdata(spark, SF001), scratch, prefix)


def test_dense_numbers(spark):
    rows = spark.range(0, 1000, 1, 13).selectExpr("id * 7919 % 1000 AS v", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS w")
    got = dense_numbers(rows, ["v"], "no", start=5).orderBy("v").collect()
    assert [r["no"] for r in got] == list(range(5, 1005)) and got[0].asDict().keys() == {"v", "w", "no"}
    assert dense_numbers(rows.limit(0), ["v"], "no").count() == 0
    assert dense_numbers(spark.range(3), ["id"], "no").schema["no"].dataType.simpleString() == "bigint"
    same_key = dense_numbers(spark.range(500).selectExpr("1 AS k"), ["k"], "no").collect()
    assert sorted(r["no"] for r in same_key) == list(range(1, 501))
