"""Defaults, geography and operator visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions.text import blank_to_null
from logspark.functions.web import address_key, address_prefix, ip_number, network
from logspark.plans.skew import HOT_ROWS, salted_join

ADDRESS_BITS = 32


def apply_defaults(logs: DataFrame, service: str, host: str) -> DataFrame:
    """Empty service, host and level get their defaults."""
    return logs.withColumns(
        {
            "service": F.coalesce(blank_to_null(F.col("service")), F.lit(service)),
            "source_host": F.coalesce(blank_to_null(F.col("source_host")), F.lit(host)),
            "level": F.coalesce(blank_to_null(F.col("level")), F.lit("info")),
        }
    )


def _bits(n: Column) -> Column:
    """Position of the highest set bit."""
    return F.length(F.bin(n)) - 1


def prefix_blocks(ranges: DataFrame) -> DataFrame:
    """Address ranges (lo, hi, ...) cut into aligned blocks (bits, prefix), at most 62 per range.

    A block holds the addresses whose number shifted right by ``bits`` is ``prefix``.
    """
    start = F.struct(
        F.col("lo").cast("long").alias("at"),
        F.array().cast("array<struct<bits:int,prefix:bigint>>").alias("done"),
    )

    def cut(acc: Column, _: Column) -> Column:
        at, left = acc["at"], F.col("hi") - acc["at"] + 1
        aligned = F.when(at == 0, F.lit(ADDRESS_BITS)).otherwise(_bits(at.bitwiseAND(-at)))
        bits = F.least(aligned, _bits(left)).cast("int")
        size = F.pow(F.lit(2.0), bits).cast("long")
        block = F.struct(bits.alias("bits"), F.call_function("div", at, size).alias("prefix"))
        return F.when(left <= 0, acc).otherwise(
            F.struct((at + size).alias("at"), F.concat(acc["done"], F.array(block)).alias("done"))
        )

    blocks = F.aggregate(F.sequence(F.lit(1), F.lit(2 * ADDRESS_BITS)), start, cut)["done"]
    return ranges.select("*", F.explode(blocks).alias("b")).select("*", "b.bits", "b.prefix").drop("b")


def geo_lookup(addresses: DataFrame, ranges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct addresses (ip) to country, region and city of the narrowest range.

    Every address is asked once per block size in use (at most 33 times) with an equality key,
    so the join gives only true hits and never pairs addresses with ranges they are outside of.
    """
    blocks = prefix_blocks(ranges)
    sizes = blocks.agg(F.collect_set("bits")).scalar()
    asked = (
        addresses.select("ip", ip_number(F.col("ip")).alias("n"))
        .filter(F.col("n").isNotNull())
        .withColumn("bits", F.explode(sizes))
        .withColumn("prefix", F.call_function("div", F.col("n"), F.pow(F.lit(2.0), "bits").cast("long")))
    )
    hits = salted_join(asked, blocks, ["bits", "prefix"], F.col("n"), "inner", hot_rows=hot_rows)
    narrowest = F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "lo", "country", "region", "city"))
    return hits.groupBy("ip").agg(narrowest.alias("g")).select("ip", "g.country", "g.region", "g.city")


def network_lookup(addresses: DataFrame, networks: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct addresses (ip) of both families to country, region and city of the longest matching prefix.

    ``networks`` has cidr, country, region and city. An address is asked once per prefix length in
    use in its family (at most 33 and 129) with an equality key, so networks may nest to any depth.
    Of networks given twice, the least country, region and city count.
    """
    keyed = networks.select(network(F.col("cidr")).alias("net"), "country", "region", "city").filter(F.col("net").isNotNull())
    blocks = keyed.groupBy("net.family", "net.bits", "net.p1", "net.p2").agg(F.min(F.struct("country", "region", "city")).alias("g"))
    blocks = blocks.toDF("family", "bits", "p1", "p2", "g")
    sizes = blocks.agg(F.collect_set(F.struct("family", "bits"))).scalar()
    asked = addresses.select("ip", address_key(F.col("ip")).alias("key")).filter(F.col("key").isNotNull())
    asked = asked.withColumn("size", F.explode(sizes)).filter(F.col("size.family") == F.col("key.family"))
    p1, p2 = address_prefix(F.col("key"), F.col("size.bits"))
    asked = asked.select("ip", "size.family", "size.bits", p1.alias("p1"), p2.alias("p2"))
    hits = salted_join(asked, blocks, ["family", "bits", "p1", "p2"], F.col("ip"), "inner", hot_rows=hot_rows)
    return hits.groupBy("ip").agg(F.max_by("g", "bits").alias("g")).select("ip", "g.country", "g.region", "g.city")


def geo_enrich(
    rows: DataFrame, ranges: DataFrame, ip: str, slice_by: Column, edge_country: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds country, region and city by address; the edge's country code fills gaps.

    ``ranges`` has number ranges (lo, hi) of IPv4 addresses, or networks of both families as ``cidr``.
    Addresses are looked up once each; an address with very many rows is cut into slices when
    its result is joined back.
    """
    drop = [c for c in ("country", "region", "city") if c in rows.columns and c != edge_country]
    counts = rows.filter(F.col(ip).isNotNull()).groupBy(F.col(ip).alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    lookup = network_lookup if "cidr" in ranges.columns else geo_lookup
    found = lookup(counts.select("ip"), ranges, hot_rows).withColumnRenamed("country", "_country")
    out = salted_join(
        rows.drop(*drop).withColumn("ip", F.col(ip)), found, ["ip"], slice_by, "left", counts, hot_rows
    )
    if ip != "ip":
        out = out.drop("ip")
    edge = blank_to_null(F.col(edge_country)) if edge_country else F.lit(None).cast("string")
    return out.withColumn("country", F.coalesce(blank_to_null(F.col("_country")), edge)).drop("_country")


def site_networks(sites: DataFrame) -> DataFrame:
    """(site_id, family, bits, p1, p2) of every excluded block; text that is no block is left out."""
    each = sites.select(F.col("id").alias("site_id"), F.explode("exclude_ips").alias("cidr"))
    return each.select("site_id", network(F.col("cidr")).alias("net")).filter(F.col("net").isNotNull()).select("site_id", "net.*")


def flag_internal(rows: DataFrame, sites: DataFrame, ip: str, hot_rows: int = HOT_ROWS,
                  slice_by: Column | None = None) -> DataFrame:
    """``is_internal``: the client address lies inside one of the site's excluded blocks.

    The blocks of a site are gathered into one small array (they are hand-kept configuration),
    and an ordinary equi-join on the site brings them to the rows.
    """
    blocks = site_networks(sites).groupBy("site_id").agg(F.collect_list(F.struct("family", "bits", "p1", "p2")).alias("_blocks"))
    client = F.col("_client")

    def holds(b: Column) -> Column:
        p1, p2 = address_prefix(client, b["bits"])
        return (b["family"] == client["family"]) & (b["p1"] == p1) & (b["p2"] == p2)

    inside = F.exists("_blocks", holds)
    plain = rows.drop("is_internal").withColumn("_client", address_key(F.col(ip)))
    key = slice_by if slice_by is not None else F.col(ip)
    joined = salted_join(plain, blocks, ["site_id"], key, "left", hot_rows=hot_rows)
    return joined.withColumn("is_internal", F.coalesce(inside, F.lit(False))).drop("_blocks", "_client")
