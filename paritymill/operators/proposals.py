"""Paper proposals from candidates and their fill simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import CANDIDATE_RECORD, FILL_SIM_RECORD, PROPOSAL_RECORD
from paritymill.functions.columns import canonical_json, decimal_text, flags, record_hash
from paritymill.functions.ordered import near_last, spread

_CANDIDATE_DECIMALS = (
    "candidate_size",
    "failed_leg_reserve_per_contract",
    "gross_edge_per_contract",
    "net_edge_per_contract",
    "total_estimated_net_edge",
)
_FILL_DECIMALS = (
    "target_size",
    "filled_yes_size",
    "filled_no_size",
    "completed_pair_size",
    "failed_leg_quantity",
    "yes_fill_price",
    "no_fill_price",
    "simulated_net_edge_per_pair",
    "simulated_total_net_edge",
    "failed_leg_reserve_total",
)


def candidate_fields() -> dict[str, Column]:
    """The candidate record as JSON-ready columns; decimals in canonical text."""
    plain = (
        "data_quality_flags", "decision", "fee_source_note", "fee_status", "flags",
        "market_id", "rejection_reasons", "research_use", "venue",
    )
    return {
        **{c: F.col(c) for c in plain},
        **{c: decimal_text(F.col(c)) for c in _CANDIDATE_DECIMALS},
        "executable_order_intent": F.lit(False),
        "record_type": F.lit(CANDIDATE_RECORD),
    }


def fill_fields() -> dict[str, Column]:
    """The simulation record as JSON-ready columns."""
    return {
        **{c: decimal_text(F.col(c)) for c in _FILL_DECIMALS},
        "venue": F.col("venue"),
        "market_id": F.col("market_id"),
        "policy": F.col("policy"),
        "flags": F.col("fill_flags"),
        "executable_order_intent": F.lit(False),
        "record_type": F.lit(FILL_SIM_RECORD),
    }


def with_candidate_hash(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("candidate_hash", record_hash(candidate_fields()))


def with_simulation_hash(fills: DataFrame) -> DataFrame:
    return fills.withColumn("simulation_hash", record_hash(fill_fields()))


def risk_preview() -> Column:
    """Ordered preview reasons; a proposal is never allowed by itself."""
    return flags(
        (F.lit(True), "manual_approval_required"),
        (F.col("decision") != "paper_candidate", "candidate_not_paper_candidate"),
        (F.col("completed_pair_size") <= 0, "simulation_not_complete"),
        (F.col("simulated_net_edge_per_pair") <= 0, "non_positive_simulated_edge"),
        (F.col("failed_leg_quantity") > 0, "partial_fill_requires_review"),
    )


def proposal_hash() -> Column:
    return F.sha2(
        canonical_json({c: F.col(c) for c in ("candidate_hash", "simulation_hash", "venue", "market_id")}),
        256,
    )


_HEX = r"^[0-9a-f]{64}$"


def _packed(c: Column) -> Column:
    """A hash as 32 bytes while it travels; other text stays text."""
    hexed = F.coalesce(c.rlike(_HEX), F.lit(False))
    return F.struct(F.when(hexed, F.unhex(c)).alias("raw"), F.when(~hexed, c).alias("text"))


def _unpacked(c: Column) -> Column:
    return F.coalesce(c["text"], F.lower(F.hex(c["raw"])))


def propose_all(candidates: DataFrame, sims: DataFrame, sim_order: str) -> DataFrame:
    """Every candidate with the proposal of its market's latest simulation, ``simulated`` or not.

    ``candidates`` carries candidate_hash and decision, ``sims`` simulation_hash and the
    fill columns.  One row per market is kept before the join, so a market repeated many
    times on the simulation side cannot multiply the output.  Simulations that are surely not the
    latest stay where they are, the others are sorted where their market is, not before they
    travel; hashes travel as bytes, and candidates are not sorted to meet their simulation.  Without a simulation
    the columns that rest on one are null and ``legs`` is empty.
    """
    kept = [
        "simulation_hash", "completed_pair_size", "failed_leg_quantity",
        "simulated_net_edge_per_pair", "yes_fill_price", "no_fill_price",
    ]
    market = ["venue", "market_id"]
    narrow = sims.select(*market, _packed(F.col(kept[0])).alias(kept[0]), *kept[1:], F.col(sim_order).alias("_order"))
    near = spread(near_last(narrow, market, "_order"), market, ["_order"], counted=narrow)
    part = near.groupBy(*market, "_salt").agg(
        F.max_by(F.struct(*kept), "_order").alias("_sim"), F.max("_order").alias("_order")
    )
    latest = part.groupBy(*market).agg(F.max_by("_sim", "_order").alias("_sim"))
    base = candidates.select(*[c for c in candidates.columns if c not in kept])
    light = base.withColumn("candidate_hash", _packed(F.col("candidate_hash")))
    joined = light.join(latest.hint("shuffle_hash"), market, "left").select(
        *[c for c in base.columns if c != "candidate_hash"],
        _unpacked(F.col("candidate_hash")).alias("candidate_hash"),
        _unpacked(F.col("_sim.simulation_hash")).alias("simulation_hash"),
        *[f"_sim.{c}" for c in kept[1:]],
        F.col("_sim").isNotNull().alias("simulated"),
    )
    leg = lambda side: F.struct(
        F.lit(side).alias("side"),
        F.col(f"{side}_fill_price").alias("limit_price"),
        F.col("completed_pair_size").alias("quantity"),
    )
    legs = F.when(F.col("completed_pair_size") > 0, F.array(leg("yes"), leg("no"))).otherwise(
        F.filter(F.array(leg("yes")), lambda x: F.lit(False))
    )
    found = F.col("simulated")
    return joined.select(*base.columns, *kept, "simulated").withColumns(
        {
            "proposal_id": F.when(found, proposal_hash()),
            "legs": legs,
            "risk_reasons": F.when(found, risk_preview()),
            "allowed_for_paper": F.lit(False),
            "record_type": F.lit(PROPOSAL_RECORD),
            "executable_order_intent": F.lit(False),
        }
    )


def propose(candidates: DataFrame, sims: DataFrame, sim_order: str) -> tuple[DataFrame, DataFrame]:
    """(proposals, candidates without a simulation) of ``propose_all``."""
    both = propose_all(candidates, sims, sim_order)
    kept = [c for c in candidates.columns if c in both.columns]
    lost = both.where(~F.col("simulated")).select(*kept)
    return both.where("simulated").drop("simulated"), lost
