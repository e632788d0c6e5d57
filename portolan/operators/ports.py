"""`dim_port`: US ports with the state and address read out of their label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portolan.functions.text import words

# Labels that name no place, and the two labels whose state can
# not be read as printed.
NO_PLACE = ["No PORT Code", "Collapsed", "UNIDENTIFED", "UNKNOWN"]
NO_PLACE_LABEL = "NA, NA"
PRINTED_AS = {
    "#INTL": "BELLINGHAM, WASHINGTON WA",
    "PASO DEL NORTE,TX": "PASO DEL NORTE, TX",
}

# A state code is two characters of A-Z or 9, so there are at most 27 * 27.
STATE_CODE = "^[A-Z9]{2}$"


def settle_label(label: Column) -> Column:
    """Replace no-place labels and the two misprints; the first match wins."""
    settled = F.when(label.rlike("|".join(NO_PLACE)), F.lit(NO_PLACE_LABEL))
    for mark, printed in PRINTED_AS.items():
        settled = settled.when(label.contains(mark), F.lit(printed))
    return settled.otherwise(label)


def known_codes(states: DataFrame) -> Column:
    """All state codes as one array value, read once per query.

    The code shape bounds the array at 729 short strings however many rows `states`
    has. A code of another shape raises: left out, its ports would vanish unseen.
    """
    code = F.col("code")
    shaped = F.when(code.rlike(STATE_CODE), code).otherwise(F.raise_error(F.concat(
        F.lit("not a state code: "), code)))
    return states.where(code.isNotNull()).agg(F.collect_set(shaped)).scalar()


def with_state(ports: DataFrame, states: DataFrame) -> DataFrame:
    """Add `words` of the settled label and `state`: the last word that is a code.

    NULL where no word is one. Narrow: no explode, no shuffle of the ports.
    """
    return (
        ports.withColumn("words", words(settle_label(F.trim(F.replace(
            F.col("value"), F.lit("'"), F.lit(""))))))
        .withColumn("state", F.try_element_at(
            F.array_intersect(F.reverse("words"), known_codes(states)), F.lit(1)))
    )


def us_ports(ports: DataFrame, states: DataFrame) -> DataFrame:
    """Ports whose label names a known state."""
    return with_state(ports, states).where(F.col("state").isNotNull())


def build_ports(ports: DataFrame, states: DataFrame) -> DataFrame:
    """(port_key, state, address); only the state word itself leaves the address."""
    word, state = F.col("words"), F.col("state")
    after = F.array_position(F.reverse(word), state).cast("int") - 1  # words behind it
    before = F.size(word) - after - 1
    return us_ports(ports, states).select(
        F.trim(F.replace(F.col("code"), F.lit("'"), F.lit(""))).alias("port_key"),
        state,
        F.concat_ws(" ", F.slice(word, F.lit(1), before),
                    F.slice(word, before + 2, after)).alias("address"),
    )
