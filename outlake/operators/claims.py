"""Identifiers and names that each belong to one row: what a loop over rows in order would keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.functions import identity, people
from outlake.sources.store import written


def greedy(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, int]:
    """``order, stays``, and how many rounds it took: in order, a row stays unless an earlier row that stays has one of
    its keys.  ``order`` tells rows apart; null keys clash with nothing.

    Rows and shared keys are a conflict graph.  In each round the rows that come first among the open ones for all their
    keys stay, as everything before them is settled; open rows that share a key with one of them go.  A round is a
    grouped minimum and a join for each key, so no key's rows are gathered; chains of rows that each wait for the one
    before are what takes rounds, and they are short unless keys alternate along them.
    """
    at, settled, rounds = written(rows.select(order, *keys)), None, 0
    while True:
        rounds += 1
        marked, first = at, F.lit(True)
        for k in keys:
            lead = at.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"__{k}"))
            marked = marked.join(lead, k, "left")
            first &= F.col(k).isNull() | (F.col(f"__{k}") == F.col(order))
        marked = written(marked.select(order, *keys, first.alias("stays")))
        won, rest = marked.where("stays"), marked.where("not stays").drop("stays")
        for k in keys:
            rest = rest.join(won.where(F.col(k).isNotNull()).select(k, F.lit(True).alias(f"__{k}")), k, "left")
        goes = reduce(lambda a, b: a | b, (F.coalesce(f"__{k}", F.lit(False)) for k in keys))
        rest = written(rest.select(order, *keys, goes.alias("goes")))
        now = won.select(order, "stays").unionByName(rest.where("goes").select(order, F.lit(False).alias("stays")))
        settled = now if settled is None else settled.unionByName(now)
        at = rest.where("not goes").drop("goes")
        if at.isEmpty():
            return settled, rounds


def identifiers(rows: DataFrame) -> DataFrame:
    """``rows`` with ``e`` and ``u``, the address and the profile as they are compared; null for blank ones."""
    e = F.nullif(identity.normal_email(F.coalesce("address", F.lit(""))), F.lit(""))
    return rows.withColumn("e", e).withColumn("u", F.nullif(F.lower(people.stored_profile(F.col("profile"))), F.lit("")))


def _holders(stored: DataFrame, key: str) -> DataFrame:
    """The stored row of each identifier, the one with the smallest id."""
    x = F.struct("contact_id", "company_id")
    return stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(x).alias(f"stored_{key}"))


def claimed(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """What inserting candidates one after another does: a row per candidate with ``inserted``, and, where an identifier
    is taken, the row that has it (the address is asked before the profile): ``contact_id`` of a stored one, or
    ``by_candidate`` of an earlier candidate; ``owner_id`` is its company, ``holder_e`` and ``holder_u`` its identifiers.

    ``candidates`` has candidate_id (the order), company_id, address and profile, ``contacts`` contact_id, company_id,
    address and profile.  Both identifiers are unique: a row needs both of its own free, and then has both.
    """
    stored = written(identifiers(contacts).select("contact_id", "company_id", "e", "u"))
    rows = identifiers(candidates).select("candidate_id", F.col("company_id").alias("wants"), "e", "u")
    rows = written(rows.join(_holders(stored, "e"), "e", "left").join(_holders(stored, "u"), "u", "left"))
    free = rows.where("stored_e is null and stored_u is null")
    kept, _ = greedy(free, ["e", "u"], "candidate_id")
    new = written(free.join(kept.where("stays").select("candidate_id"), "candidate_id").select("candidate_id", "wants", "e", "u"))

    def made(key: str) -> DataFrame:
        x = F.struct("candidate_id", F.col("wants").alias("company_id"))
        return new.where(F.col(key).isNotNull()).select(key, x.alias(f"new_{key}"))

    at = rows.join(new.select("candidate_id", F.lit(True).alias("inserted")), "candidate_id", "left").join(made("e"), "e", "left").join(made("u"), "u", "left")
    at = at.withColumn("inserted", F.coalesce("inserted", F.lit(False)))

    def holder(key: str) -> Column:
        before = F.col(f"new_{key}.candidate_id") < F.col("candidate_id")
        none = F.lit(None).cast("long")
        old = F.struct(F.col(f"stored_{key}.contact_id").cast("long").alias("contact_id"), none.alias("by_candidate"), F.col(f"stored_{key}.company_id").cast("long").alias("owner_id"))
        young = F.struct(none.alias("contact_id"), F.col(f"new_{key}.candidate_id").cast("long").alias("by_candidate"), F.col(f"new_{key}.company_id").cast("long").alias("owner_id"))
        return F.when(F.col(f"stored_{key}").isNotNull(), old).when(before, young)

    found = at.withColumn("h", F.when(~F.col("inserted"), F.coalesce(holder("e"), holder("u"))))
    found = found.select("candidate_id", "wants", "e", "u", "inserted", "h.contact_id", "h.by_candidate", "h.owner_id")
    old = stored.select("contact_id", F.col("e").alias("old_e"), F.col("u").alias("old_u"))
    young = new.select(F.col("candidate_id").alias("by_candidate"), F.col("e").alias("new_e"), F.col("u").alias("new_u"))
    both = found.join(old, "contact_id", "left").join(young, "by_candidate", "left")
    return both.select("candidate_id", "wants", "e", "u", "inserted", "contact_id", "by_candidate", "owner_id", F.coalesce("old_e", "new_e").alias("holder_e"), F.coalesce("old_u", "new_u").alias("holder_u"))


def attached(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """What attaching verified candidates to their companies does, in order: ``candidate_id, action`` (attach, enrich,
    conflict or nothing), which channels are on the row that came back, ``new_outreach`` (a new row with a channel), and
    ``conflict`` (owner: the row is another company's; profile: the row is this company's, its profile another).

    ``candidates`` has usable channels only, as ``claimed`` takes them.
    """
    given = F.col("e").isNotNull() | F.col("u").isNotNull()
    at = claimed(candidates, contacts)
    elsewhere = ~F.col("inserted") & F.col("owner_id").isNotNull() & ~F.col("owner_id").eqNullSafe(F.col("wants").cast("long"))
    action = F.when(~given, "nothing").when(F.col("inserted"), "attach").when(elsewhere, "conflict").otherwise("enrich")
    lands = lambda own, held: F.coalesce(F.col(own).isNotNull() & ~elsewhere & (F.col("inserted") | (F.col(own) == F.col(held))), F.lit(False))
    email, profile = lands("e", "holder_e"), lands("u", "holder_u")
    conflict = F.when(elsewhere, "owner").when(F.col("u").isNotNull() & ~profile, "profile")
    return at.select("candidate_id", action.alias("action"), email.alias("email_lands"), profile.alias("profile_lands"), (F.col("inserted") & (email | profile)).alias("new_outreach"), F.when(given, conflict).alias("conflict"))


def import_outcomes(candidates: DataFrame, decided: DataFrame, contacts: DataFrame) -> DataFrame:
    """``candidate_id, outcome`` of an import, row by row: what the gate refuses is invalid; an accepted row whose address
    or profile a stored row or an earlier accepted row has is a duplicate; the others are added.

    ``decided`` has candidate_id and decision (see ``ingest.gate``).
    """
    fine = decided.where("decision like 'accept%'").select("candidate_id")
    rows = claimed(candidates.join(fine, "candidate_id", "left_semi"), contacts)
    said = rows.select("candidate_id", F.when(F.col("inserted"), "added").otherwise("duplicate").alias("outcome"))
    return decided.select("candidate_id").join(said, "candidate_id", "left").select("candidate_id", F.coalesce("outcome", F.lit("invalid")).alias("outcome"))
