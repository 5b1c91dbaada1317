"""Feature aggregation over the price and client tables, and period-over-period price changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwatt.functions import whole_months
from keepwatt.schemas import FEATURE_COLUMNS, MONTH_FEATURES, PRICE_COLUMNS
from keepwatt.session import stage

DEFAULT_AS_OF = "2016-01-01"


def client_consumption_distinct(client: DataFrame, id_column: str = "id",
                                value_column: str = "cons_12m") -> DataFrame:
    """Distinct (client, consumption) pairs."""
    return client.select(id_column, value_column).distinct()


def _mean(name: str) -> Column:
    return F.avg(F.col(name).cast("double"))


def _same_id(collation: str | None) -> Column:
    """The id that rows are grouped and joined by."""
    return F.col("id") if collation is None else F.collate(F.col("id"), collation).alias("id")


def price_statistics(price: DataFrame, collation: str | None = None) -> DataFrame:
    """Level, ratio, spread and range of each price band, one row per client id.

    A zero off-peak price makes that row's ratio NULL, so the mean skips it. The spread is
    the population form: a single price row gives 0, not NULL.
    """
    off_peak, peak, mid_peak = "price_off_peak_var", "price_peak_var", "price_mid_peak_var"
    ratio = F.try_divide(F.col(peak).cast("double"), F.col(off_peak).cast("double"))

    def spread(name: str) -> Column:
        return F.round(F.stddev_pop(F.col(name).cast("double")), 3).alias(f"std_{name}")

    def level(name: str) -> Column:
        return F.round(_mean(name), 3).alias(f"avg_{name}")

    def value_range(name: str) -> Column:
        c = F.col(name).cast("double")
        return F.round(F.max(c) - F.min(c), 3).alias(f"range_{name}")

    return price.where(F.col("id").isNotNull()).groupBy(_same_id(collation)).agg(
        *[level(name) for name in (off_peak, peak, mid_peak)],
        F.round(F.avg(ratio), 3).alias("price_peak_off_peak_ratio_var"),
        *[spread(name) for name in (off_peak, peak, mid_peak)],
        *[value_range(name) for name in (peak, off_peak, mid_peak)],
    )


def client_statistics(client: DataFrame, as_of: str = DEFAULT_AS_OF,
                      collation: str | None = None) -> DataFrame:
    """Tenure, contract timing, consumption and margins, one row per client, channel and
    the three month counts. Missing dates give missing month counts and keep their group."""
    anchor = F.lit(as_of).cast("timestamp")
    dated = client.where(F.col("id").isNotNull()).withColumns({
        "months_to_end": whole_months(anchor, F.col("date_end")),
        "months_since_modified": whole_months(F.col("date_modif_prod"), anchor),
        "months_since_renewed": whole_months(F.col("date_renewal"), anchor),
    })
    return dated.groupBy(_same_id(collation), "channel_sales", *MONTH_FEATURES).agg(
        *([] if collation is None else [F.min("id").alias("first_id")]),
        F.floor(_mean("num_years_antig")).alias("tenure_years"),
        F.round(_mean("cons_12m")).alias("yearly_consumption"),
        F.floor(_mean("cons_last_month")).alias("monthly_consumption"),
        F.floor(_mean("cons_gas_12m")).alias("yearly_gas_consumption"),
        F.round(_mean("forecast_cons_12m")).alias("yearly_forecast_consumption"),
        F.round(_mean("forecast_meter_rent_12m"), 3).alias("yearly_forecast_meter_rent"),
        F.round(_mean("imp_cons"), 3).alias("paid_consumption"),
        F.round(_mean("margin_gross_pow_ele"), 3).alias("net_margin_electricity"),
        F.round(_mean("margin_net_pow_ele"), 3).alias("net_margin_power"),
        F.round(_mean("net_margin"), 3).alias("net_margin"),
        F.floor(_mean("churn")).alias("churn"),
    )


def price_sensitivity_features(price: DataFrame, client: DataFrame,
                               as_of: str = DEFAULT_AS_OF,
                               collation: str | None = None) -> DataFrame:
    """The 26-column feature table.

    Stated on the joined rows, every measure is an average, population spread, minimum or
    maximum within (id, channel, month counts). Inside such a group the join repeats each
    price row once per client row and the other way round, and none of these measures changes
    when all rows are repeated equally often. So both tables are aggregated first, each with
    map-side partial aggregation that folds a hot id into one row per task, and the join sees
    one price row per id.

    Ids are compared byte by byte. With a ``collation`` such as UTF8_LCASE or UNICODE_CI_AI,
    ids that it takes for equal are one client, shown as the first of them.
    """
    # off its own exchange, the small side lets adaptive execution split a hot id
    joined = price_statistics(price, collation).hint("rebalance").join(
        client_statistics(client, as_of, collation), "id", "inner")
    if collation is not None:
        joined = joined.withColumn("id", F.col("first_id"))
    return joined.select(*FEATURE_COLUMNS)


def price_changes(price: DataFrame, columns: list[str] | None = None, key: str = "id",
                  order: str = "price_date", pieces: int | None = None) -> DataFrame:
    """Change of each price against the client's previous price date; NULL on the first one.

    Rows of one client and date are peers: all of them are compared with the previous date that
    differs, and where that one has several rows, with the last of these by the values of
    ``columns`` in their order. So the result does not depend on how rows are dealt out. The
    order column may have any type that Spark can sort; missing dates come first, as peers.

    All lags share one shuffle and one sort by client. A client with too many rows for one task
    is cut up if the caller asks for ``pieces``, see ``lags_in_pieces`` and ``history_pieces``.
    """
    columns = columns or PRICE_COLUMNS
    base = price.select(key, order, *columns)
    if pieces is None:
        in_order = Window.partitionBy(key).orderBy(order, *columns)
        row = F.struct(F.col(order).alias("at"), F.struct(*columns).alias("last"))
        before = base.withColumn("before", F.lag(row).over(in_order))
        # the first of its peers has the row before them at hand, the others look back to it
        first = F.col("before").isNull() | ~F.col("before.at").eqNullSafe(F.col(order))
        held = F.last(F.when(first, F.struct("before.last")), True).over(
            in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        lagged = before.withColumn("last", held.getField("last"))
    else:
        lagged = lags_in_pieces(base, pieces, columns, key, order)
    return lagged.select(
        key, order,
        *[(F.col(c) - F.col(f"last.{c}")).alias(f"{c}_change") for c in columns],
    )


def history_pieces(price: DataFrame, key: str = "id", group_rows: int = 1_000_000) -> int | None:
    """How many pieces ``price_changes`` should be asked for: about one for each ``group_rows``
    rows if a client has more than that many, else None. Counts the rows."""
    counts = price.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    if (top["largest"] or 0) <= group_rows:
        return None
    return -(-top["rows"] // group_rows)


def lags_in_pieces(base: DataFrame, pieces: int, columns: list[str], key: str,
                   order: str) -> DataFrame:
    """``base`` with ``last``, the previous values, found within ranges of (key, order).

    Peers are folded into their last row first, by partial aggregation. Ranges are cut by sampled
    positions, so they are of similar size whatever the keys; the last row of a range is also put
    into the next one, where it sorts first and serves as the predecessor of the first row. Rows
    meet the result by key and date, where adaptive execution can split many peers. The ranges
    are written, so this runs a job.
    """
    folded = base.groupBy(key, order).agg(F.max(F.struct(*columns)).alias("own"))
    ranged = stage(folded.repartitionByRange(pieces, key, order)
                   .withColumn("piece", F.spark_partition_id()), "price-ranges")
    # one row per piece, also for the window without a partition
    ends = ranged.groupBy("piece").agg(
        F.max_by(F.struct(key, order, "own"), F.struct(key, order)).alias("end"))
    carried = ends.select("end.*", F.lead("piece").over(Window.orderBy("piece")).alias("piece"))
    rows = ranged.withColumn("carried", F.lit(False)).unionByName(
        carried.where("piece IS NOT NULL").withColumn("carried", F.lit(True)))
    window = Window.partitionBy("piece").orderBy(key, order)
    before = rows.withColumn("before", F.lag(F.struct(key, "own")).over(window))
    same_key = F.col("before").isNotNull() & F.col(f"before.{key}").eqNullSafe(F.col(key))
    lags = before.where("NOT carried").select(
        F.col(key).alias("lag_key"), F.col(order).alias("lag_order"),
        F.when(same_key, F.col("before.own")).alias("last"))
    return base.join(lags, F.col(key).eqNullSafe(F.col("lag_key"))
                     & F.col(order).eqNullSafe(F.col("lag_order")))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once, with their number of rows."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise if a key combination occurs more than once."""
    example = repeated_keys(df, keys).limit(1).collect()
    if example:
        values = ", ".join(f"{k}={example[0][k]!r}" for k in keys)
        raise ValueError(f"{keys} is not unique: {example[0]['n_rows']} rows with {values}")
    return df
