"""Column expressions over filing records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.codes import EARMARK_TYPES, INDEPENDENT, STATES, STOP_WORDS, TRANSFER_TYPES




def person_key(name: Column, employer: Column, occupation: Column, zip_code: Column) -> Column:
    """Identity of an unregistered person; employer and occupation count only if an occupation is given."""
    sep = F.lit(" - ")
    full = F.concat(name, sep, employer, sep, occupation, sep, zip_code)
    return F.md5(F.when(occupation != "", full).otherwise(F.concat(name, sep, zip_code)))


def organisation_key(name: Column, zip_code: Column) -> Column:
    return F.md5(F.concat(name, F.lit(" - "), zip_code))


def is_earmark(tx_type: Column) -> Column:
    return tx_type.isin(*EARMARK_TYPES)


def entity_bucket(entity_id: Column) -> Column:
    """committee, candidate or individual, by the id's length and first letter."""
    first = F.substring(entity_id, 1, 1)
    return (
        F.when(F.length(entity_id) >= 16, "individual")
        .when(first == "C", "committee")
        .when(first.isin("H", "S", "P"), "candidate")
        .otherwise("individual")
    )


def is_incoming(tx_type: Column) -> Column:
    """Types are compared as text."""
    return (tx_type < "20") | ((tx_type >= "30") & (tx_type < "33"))


def is_transfer(tx_type: Column) -> Column:
    return tx_type.isin(*TRANSFER_TYPES)


def is_contribution(tx_type: Column) -> Column:
    """Among incoming types; the others are other receipts."""
    return (tx_type < "16") | (tx_type > "18")


def party_bucket(party: Column) -> Column:
    return (
        F.when(party.isin("REP", "DEM"), party)
        .when(party.isin(*INDEPENDENT), "IND")
        .when(party.isin("", "UNK", "???"), "UNK")
        .otherwise("OTH")
    )


def money(text: Column) -> Column:
    """A decimal of cents; what is no number is 0."""
    return F.coalesce(text.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def ratio(amount: Column, count: Column) -> Column:
    """amount / count as a double; 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(amount.cast("double"), count.cast("double")), F.lit(0.0))


def filing_date(text: Column, layout: str = "MMddyyyy") -> Column:
    """The date of a text of digits, or of one with slashes; null if it is none."""
    return F.to_date(F.try_to_timestamp(text, F.lit(layout)))


def terms(texts: Column) -> Column:
    """Distinct search terms of an array of texts: lower case, divided at all but letters and digits, without stop words."""
    plain = F.translate(F.lower(F.array_join(texts, " ")), "',", "")
    # array_except leaves each word once, in its first place.
    return F.array_except(F.split(plain, "[^a-z0-9]+"), F.array(*map(F.lit, STOP_WORDS)))


def state_name(state: Column) -> Column:
    pairs = [F.lit(x) for pair in STATES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), state), F.lit(""))


def index_partition(term: Column) -> Column:
    return F.substring(term, 1, 1)


def lookup_partition(entity_id: Column) -> Column:
    """The end of a registered id, the beginning of a hashed one."""
    return F.when(F.length(entity_id) == 9, F.substring(entity_id, 8, 2)).when(F.length(entity_id) == 32, F.substring(entity_id, 1, 2)).otherwise("")


def is_entity_id(text: Column) -> Column:
    return (F.length(text) == 32) | text.rlike("^[CHSPchsp][0-9]{8}$")


def canonical_id(text: Column) -> Column:
    """Registered ids in upper case, hashed ones in lower case."""
    return F.when(F.length(text) == 9, F.upper(text)).otherwise(F.lower(text))
