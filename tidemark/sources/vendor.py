"""Normalisation of landed vendor files to the engine's table shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import dates, quotes

BAR_COLUMNS = ["market", "open", "high", "low", "close", "volume", "symbol", "ts_event"]

# --- fixed values: alternative spellings of report columns, first present wins
COT_SPELLINGS = {
    "code": ["CFTC_Contract_Market_Code", "CFTC Contract Market Code", "cftc_contract_market_code"],
    "report_date": ["As_of_Date_In_Form_YYMMDD", "Report_Date_as_YYYY-MM-DD"],
    "managed_money_long": ["M_Money_Positions_Long_All", "M_Money_Positions_Long_ALL"],
    "managed_money_short": ["M_Money_Positions_Short_All", "M_Money_Positions_Short_ALL"],
    "producer_long": ["Prod_Merc_Positions_Long_All", "Prod_Merc_Positions_Long_ALL"],
    "producer_short": ["Prod_Merc_Positions_Short_All", "Prod_Merc_Positions_Short_ALL"],
    "swap_long": ["Swap_Positions_Long_All", "Swap__Positions_Long_All"],
    "swap_short": ["Swap_Positions_Short_All", "Swap__Positions_Short_All"],
    "total_oi": ["Open_Interest_All", "Open_Interest_ALL"],
}


def _bar(df: DataFrame, symbol: Column, when: Column) -> DataFrame:
    return df.select(
        F.col("market"),
        *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").try_cast("long").alias("volume"),
        symbol.cast("string").alias("symbol"),
        when.cast("timestamp_ntz").alias("ts_event"),
    )


def exchange_bars(df: DataFrame) -> DataFrame:
    """A4, contract-level vendor: rows carry their own symbol and an event time."""
    return _bar(df, F.coalesce(F.col("symbol"), F.concat("market", F.lit(".FUT"))), F.col("ts_event"))


def broker_bars(df: DataFrame) -> DataFrame:
    """A4, continuous-contract vendor: the market is the symbol, the date is text."""
    return _bar(df, F.col("market"), dates.parse_date(F.substring(F.trim("date"), 1, 10)))


def snapshot_bars(df: DataFrame, batch_time: Column) -> DataFrame:
    """B9, snapshot fallback: missing open/high/low take the usable last or close price."""
    price = F.when(quotes.usable(F.col("last")), F.col("last")).otherwise(F.col("close"))
    fill = lambda name: F.when(quotes.usable(F.col(name)), F.col(name)).otherwise(price)
    return df.where(quotes.usable(price)).select(
        "market",
        fill("open").alias("open"),
        fill("high").alias("high"),
        fill("low").alias("low"),
        price.alias("close"),
        quotes.nan_default(F.col("volume")).cast("long").alias("volume"),
        F.col("market").alias("symbol"),
        batch_time.cast("timestamp_ntz").alias("ts_event"),
    )


def _pick(df: DataFrame, target: str) -> Column | None:
    for name in COT_SPELLINGS[target]:
        if name in df.columns:
            return F.col(f"`{name}`")
    return None


def cot_normalize(raw: DataFrame, markets: DataFrame, batch_date: Column) -> DataFrame:
    """A5: report rows of the wanted contracts with nets, release time and revision flag.

    Codes compare as trimmed text.  The market dimension has fourteen rows, so
    the join is a broadcast and the report table is neither shuffled nor copied.
    Rows whose date fits no known format are dropped.
    """
    code = F.trim(_pick(raw, "code").cast("string"))
    picked = {t: _pick(raw, t) for t in COT_SPELLINGS if t not in ("code", "report_date")}
    rows = raw.select(
        code.alias("cftc_code"),
        dates.report_date(_pick(raw, "report_date")).alias("report_date"),
        *[
            (c.try_cast("double") if c is not None else F.lit(0.0)).alias(name)
            for name, c in picked.items()
        ],
    ).where(F.col("report_date").isNotNull())
    dim = markets.select(F.col("symbol").alias("market"), F.col("cftc_code"))
    return cot_enrich(rows.join(F.broadcast(dim), "cftc_code").drop("cftc_code"), batch_date)


def cot_enrich(rows: DataFrame, batch_date: Column) -> DataFrame:
    """Nets, release time and the four-week revision flag for parsed report rows."""
    net = lambda side: F.col(f"{side}_long") - F.col(f"{side}_short")
    return rows.select(
        "market",
        "report_date",
        dates.release_time(F.col("report_date")).alias("available_at"),
        "managed_money_long",
        "managed_money_short",
        net("managed_money").alias("managed_money_net"),
        "producer_long",
        "producer_short",
        net("producer").alias("producer_net"),
        "swap_long",
        "swap_short",
        net("swap").alias("swap_net"),
        "total_oi",
        (F.col("report_date") >= F.date_sub(batch_date, 7 * config.REVISION_WEEKS)).alias(
            "is_revision_window"
        ),
    )
