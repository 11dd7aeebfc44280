"""Marketplace entities derived from the driver's star schema, as DataFrames and as DuckDB views.

A listing is a line item with its part and order; a comparable edge joins an active and a sold listing of one part.
Both forms of a view state the same rule; `with_views` puts the SQL forms that a query names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" for every formula that needs it.
AS_OF = "2002-01-01"

#: Titles that exercise the rules on labelled pairs; a pair takes two of them by its key.
PHRASES = (
    "PS5 Slim digital edition sealed 1TB", "PS5 disc edition 825GB for parts", "PlayStation 5 disc version boxed", "MacBook Pro M3 Max 512GB grade A", "MacBook Air M2 256GB scratches",
    "ThinkPad i7 16GB RAM 512GB SSD black", "ThinkPad i5 8GB RAM 256GB SSD", "Lot of 5 game pads", "game pad like new", "Premium Collection box sealed", "Ultra-Premium Collection box sealed",
    "DeWalt 18V drill replacement battery", "DeWalt 20V drill good condition", "Watch 45mm silver pre-owned", "Watch 41mm gold worn", "10 pack filters brand new",
)

SQL_VIEWS: dict[str, str] = {
    "pairs": f"""SELECT p_partkey AS pair_id, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS job_id, p_partkey % 3 <> 0 AS comparable, ({list(PHRASES)!r})[p_partkey % {len(PHRASES)} + 1] AS a, ({list(PHRASES)!r})[(p_partkey * 5 + 3) % {len(PHRASES)} + 1] AS b,
        p_size / 50.0::DOUBLE AS similarity, (p_partkey * 7 % 41 - 20) / 5.0::DOUBLE AS logit, p_name AS description FROM part""",
    "jobs": """SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS job_id, p_brand AS search_term,
        CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 5 <> 0 AS is_enabled FROM part""",
    "categories": """SELECT p_type AS category, p_type <> 'PROMO' AS is_enabled FROM part GROUP BY p_type""",
    "job_categories": """SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS job_id, p_type AS category FROM part WHERE p_partkey % 3 = 0""",
    "listings": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS listing_id,
        CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS job_id, l_partkey AS part_id, l_orderkey AS ord, p_type AS category,
        CASE WHEN (l_partkey + l_orderkey) % 101 = 0 THEN NULL ELSE concat_ws(' ', p_brand, p_name, p_type, p_size) END AS title,
        CASE WHEN (l_partkey + l_orderkey) % 97 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS price,
        l_extendedprice / l_quantity * l_tax AS shipping,
        CASE l_suppkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
        CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'NEW' WHEN l_returnflag = 'N' THEN 'USED' ELSE 'REFURBISHED' END AS condition,
        CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_suppkey % 11 = 0 THEN 'OutOfStock' ELSE 'Active' END WHEN l_suppkey % 5 = 0 THEN 'Ended' ELSE 'Sold' END AS status,
        least(o_orderdate, l_shipdate) AS created,
        CASE WHEN l_linestatus = 'O' THEN NULL ELSE greatest(o_orderdate, l_shipdate) END AS ended,
        concat_ws(' ', p_name, p_type, o_orderpriority) AS description
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "edges": """SELECT least(a.listing_id, s.listing_id) AS id_a, greatest(a.listing_id, s.listing_id) AS id_b,
        (a.ord * 31 + s.ord * 17) % 100 < 22 AS is_comparable, 0.5 + ((a.ord * 7 + s.ord * 13) % 50) / 100.0::DOUBLE AS similarity,
        CASE WHEN (a.ord + s.ord) % 7 = 0 THEN NULL ELSE 0.5 + ((a.ord * 3 + s.ord * 5) % 50) / 100.0::DOUBLE END AS confidence
        FROM listings a JOIN listings s ON a.part_id = s.part_id WHERE a.status = 'Active' AND s.status = 'Sold'""",
    "runs": """SELECT event_id AS run_id, user_id AS batch_id, CAST(floor(value * 100 + 0.5) AS BIGINT) % 24 AS job_id, ts AS started,
        CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL 5 MINUTE END AS completed,
        CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'click' THEN 'Completed' WHEN 'signup' THEN 'Running' WHEN 'view' THEN 'Queued' ELSE 'Failed' END AS status,
        event_id % 17 AS added_active, event_id % 11 AS added_sold, event_id % 5 AS failed_items FROM events""",
    "issues": """SELECT event_id AS issue_id, event_id - event_id % 3 AS run_id, CASE WHEN value < 5 THEN 'Parse' ELSE 'Http' END AS kind FROM events WHERE event_type = 'error'""",
    "history": """SELECT event_id AS history_id, user_id AS listing, ts AS recorded, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS price,
        CASE event_type WHEN 'purchase' THEN 'Sold' WHEN 'error' THEN 'Ended' WHEN 'click' THEN 'OutOfStock' ELSE 'Active' END AS status FROM events""",
    "comps": """SELECT a.listing_id AS active_id, s.listing_id AS sold_id, a.price AS ask, a.shipping, a.job_id, a.condition AS a_condition, s.condition AS s_condition,
        s.price AS sold_price, s.created, s.ended, e.similarity, e.confidence
        FROM (SELECT id_a AS x, id_b AS y, * FROM edges WHERE is_comparable UNION ALL SELECT id_b, id_a, * FROM edges WHERE is_comparable) e
        JOIN listings a ON a.listing_id = e.x AND a.status = 'Active' JOIN listings s ON s.listing_id = e.y AND s.status = 'Sold'""",
    "cleaned": """SELECT c.*, n FROM comps c JOIN (SELECT active_id, quantile_cont(sold_price, 0.25) AS q1, quantile_cont(sold_price, 0.75) AS q3, count(*) AS n FROM comps WHERE sold_price > 0 GROUP BY active_id) q
        ON c.active_id = q.active_id WHERE sold_price > 0 AND (n < 4 OR q1 = q3 OR sold_price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
    "preds": f"""SELECT * FROM (SELECT g.*, CAST(CAST(mean_price AS DECIMAL(18, 2)) AS DOUBLE) * (1 - 0.1325) - ask - coalesce(shipping, 0) AS profit FROM
        (SELECT active_id, count(*) AS n, sum(sold_price * w) / nullif(sum(w), 0) AS mean_price, first(ask) AS ask, first(shipping) AS shipping, first(job_id) AS job_id,
        CAST(trunc(avg(date_diff('day', created, ended))) AS BIGINT) AS days_to_sell,
        0.3 * (1 - exp(-count(*) / 20.0::DOUBLE)) + 0.4 * avg(coalesce(confidence, similarity)) + 0.3 * CASE WHEN count(*) = 1 THEN 0 ELSE greatest(0, 1 - stddev_samp(sold_price) / nullif(avg(sold_price), 0)) END AS confidence,
        first(n) - count(*) AS outliers_removed, quantile_cont(sold_price, 0.5) AS median_price
        FROM (SELECT *, pow(coalesce(confidence, similarity), 2) * CASE WHEN ended IS NULL THEN 1 ELSE exp(-date_diff('day', ended, TIMESTAMP '{AS_OF}') / 30.0::DOUBLE) END AS w FROM cleaned)
        GROUP BY active_id) g) WHERE n >= 3 AND profit > 0""",
    "cells": """SELECT listing_id, job_id, title, category, split_part(title, ' ', 2) AS colour, coalesce(price, 0) AS price, status = 'Sold' AS is_sold, status = 'Active' AS is_active, condition, created, ended,
        'category=' || category || ' | colour=' || split_part(title, ' ', 2) || coalesce(' | condition=' || condition, '') AS cell_key FROM listings WHERE title IS NOT NULL AND status IN ('Active', 'Sold')""",
    "titles": """SELECT listing_id, job_id, status, price, condition, created, ended, title FROM listings WHERE title IS NOT NULL""",
}


#: Added before rounding in both engines: sums that differ in the last bit must not part at a tie.
NUDGE = 3e-7


def with_views(sql: str) -> str:
    """The query, with nudged rounding and with the views that it names, directly or through others, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    nudged = lambda text: re.sub(r"\bround\(", f"round({NUDGE}::DOUBLE + ", text)
    sql = nudged(sql)
    if not needed:
        return sql
    views = ", ".join(f"{n} AS ({nudged(SQL_VIEWS[n])})" for n in needed)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {own[1] or ''}{views}, {sql[own.end():]}" if own else f"WITH {views} {sql}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Rounding as `with_views` does it."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), digits)


def _job(brand: str) -> Column:
    return F.regexp_extract(brand, "[0-9]+", 0).cast("bigint")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("search_term")).distinct()
    return brands.select(_job("search_term").alias("job_id"), "search_term", (_job("search_term") % 5 != 0).alias("is_enabled"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_type").alias("category")).distinct().withColumn("is_enabled", F.col("category") != "PROMO")


def job_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(_job("p_brand").alias("job_id"), F.col("p_type").alias("category")).distinct()


def lines(spark: SparkSession, sf_dir: str, part: DataFrame) -> DataFrame:
    """Line items joined with their part and order; one row each, those of an order in one task."""
    return read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def listing_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def part_title() -> Column:
    return F.concat_ws(" ", "p_brand", "p_name", "p_type", "p_size")


def titled() -> Column:
    """Whether a line item's listing has a title."""
    return (F.col("l_partkey") + F.col("l_orderkey")) % 101 != 0


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items joined with their part (a small dimension) and order; one row each."""
    rows = lines(spark, sf_dir, read(spark, sf_dir, "part"))
    price, mark, open_ = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_partkey") + F.col("l_orderkey"), F.col("l_linestatus") == "O"
    return rows.select(
        listing_id().alias("listing_id"),
        _job("p_brand").alias("job_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_orderkey").alias("ord"),
        F.col("p_type").alias("category"),
        F.when(titled(), part_title()).alias("title"),
        F.when(mark % 97 != 0, price).alias("price"),
        (price * F.col("l_tax")).alias("shipping"),
        F.when(F.col("l_suppkey") % 3 == 0, "GBP").when(F.col("l_suppkey") % 3 == 1, "USD").otherwise("EUR").alias("currency"),
        F.when(F.col("l_linenumber") == 7, None).when(F.col("l_returnflag") == "A", "NEW").when(F.col("l_returnflag") == "N", "USED").otherwise("REFURBISHED").alias("condition"),
        F.when(open_, F.when(F.col("l_suppkey") % 11 == 0, "OutOfStock").otherwise("Active")).when(F.col("l_suppkey") % 5 == 0, "Ended").otherwise("Sold").alias("status"),
        F.least("o_orderdate", "l_shipdate").alias("created"),
        F.when(~open_, F.greatest("o_orderdate", "l_shipdate")).alias("ended"),
        F.concat_ws(" ", "p_name", "p_type", "o_orderpriority").alias("description"),
    )


def edges(spark: SparkSession, sf_dir: str, of: Column | None = None) -> DataFrame:
    """Undirected comparable edges, id_a < id_b, from active and sold listings of one part; `of` picks listings."""
    rows = listings(spark, sf_dir)
    rows = (rows if of is None else rows.where(of)).select("listing_id", "part_id", "ord", "status")
    a = rows.where("status = 'Active'").select("part_id", F.col("listing_id").alias("a_id"), F.col("ord").alias("a"))
    s = rows.where("status = 'Sold'").select("part_id", F.col("listing_id").alias("s_id"), F.col("ord").alias("s"))
    x, y = F.col("a"), F.col("s")
    return a.join(s, "part_id").select(
        F.least("a_id", "s_id").alias("id_a"),
        F.greatest("a_id", "s_id").alias("id_b"),
        ((x * 31 + y * 17) % 100 < 22).alias("is_comparable"),
        (0.5 + ((x * 7 + y * 13) % 50) / F.lit(100.0)).alias("similarity"),
        F.when((x + y) % 7 != 0, 0.5 + ((x * 3 + y * 5) % 50) / F.lit(100.0)).alias("confidence"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("batch_id"),
        (F.floor(F.col("value") * 100 + 0.5) % 24).cast("bigint").alias("job_id"),
        F.col("ts").alias("started"),
        F.when(kind != "view", F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("completed"),
        F.when(kind.isin("purchase", "click"), "Completed").when(kind == "signup", "Running").when(kind == "view", "Queued").otherwise("Failed").alias("status"),
        (F.col("event_id") % 17).alias("added_active"),
        (F.col("event_id") % 11).alias("added_sold"),
        (F.col("event_id") % 5).alias("failed_items"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.select(F.col("event_id").alias("issue_id"), (F.col("event_id") - F.col("event_id") % 3).alias("run_id"), F.when(F.col("value") < 5, "Parse").otherwise("Http").alias("kind"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "Sold").when(kind == "error", "Ended").when(kind == "click", "OutOfStock").otherwise("Active")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("history_id"), F.col("user_id").alias("listing"), F.col("ts").alias("recorded"), F.when(kind != "view", F.col("value")).alias("price"), status.alias("status"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where("title IS NOT NULL").select("listing_id", "job_id", "status", "price", "condition", "created", "ended", "title")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs of titles, one for each part."""
    phrases, n, key = F.array(*(F.lit(p) for p in PHRASES)), len(PHRASES), F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("pair_id"),
        _job("p_brand").alias("job_id"),
        (key % 3 != 0).alias("comparable"),
        F.element_at(phrases, (key % n + 1).cast("int")).alias("a"),
        F.element_at(phrases, ((key * 5 + 3) % n + 1).cast("int")).alias("b"),
        (F.col("p_size") / F.lit(50.0)).alias("similarity"),
        ((key * 7 % 41 - 20) / F.lit(5.0)).alias("logit"),
        F.col("p_name").alias("description"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and sold listings with a title, assigned to a cell of category, colour and condition; a null price is 0."""
    from ..operators.cells import cell_key

    rows = listings(spark, sf_dir).where("title IS NOT NULL AND status IN ('Active', 'Sold')")
    colour = F.split_part("title", F.lit(" "), F.lit(2))
    rows = rows.select("listing_id", "job_id", "title", "category", colour.alias("colour"), F.coalesce("price", F.lit(0.0)).alias("price"), (F.col("status") == "Sold").alias("is_sold"), (F.col("status") == "Active").alias("is_active"), "condition", "created", "ended")
    return rows.withColumn("cell_key", cell_key(F.create_map(F.lit("category"), F.col("category"), F.lit("colour"), F.col("colour")), F.col("condition")))
