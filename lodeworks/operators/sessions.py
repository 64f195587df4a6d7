"""Messages of sessions, validation of extractions, and packets of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.schema import ENTITY_KINDS

#: Caps of an extraction and of the sections of an answer packet. Fixed values.
EXTRACTION_CAPS = {"entities": 50, "experiments": 20, "relationships": 30}
PACKET_CAPS = {"matched": 16, "experiments": 12, "observations": 24, "history": 12, "gaps": 12, "evidence": 16, "hits": 10, "relations": 20}


def last_messages(messages: DataFrame, n: int = 10, session: str = "session_id", position: str = "position") -> DataFrame:
    """The last ``n`` messages of each session, in order; a long session is cut by rank before anything is kept."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(position)))
    return messages.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r").orderBy(session, position)


def live_sessions(messages: DataFrame, now: str, ttl_seconds: int = 3600, session: str = "session_id", at: str = "timestamp") -> DataFrame:
    """(session, last_active) of sessions with a message within the time to live."""
    last = messages.groupBy(session).agg(F.max(at).alias("last_active"))
    return last.filter(F.col("last_active") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))


def validate_extraction(entities: DataFrame, relations: DataFrame, per: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Valid entities (per, pos, name, kind) and relations (per, pos, source, target, type) of each document.

    Nameless entities are dropped, the first of a name stays, an unknown kind becomes document; relations need
    both ends among the valid names. Caps apply after validation, in order of position.
    """
    named = entities.withColumn("name", F.trim("name")).filter("name is not null and name <> ''")
    first = Window.partitionBy(per, "name").orderBy("pos")
    one = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    kind = F.lower(F.trim("kind"))
    kept = one.withColumn("kind", F.when(kind.isin(*ENTITY_KINDS), kind).otherwise("document"))
    capped = kept.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy("pos"))).filter(F.col("_n") <= EXTRACTION_CAPS["entities"]).drop("_n")
    known = kept.select(per, "name")
    ends = relations.join(known.withColumnRenamed("name", "source"), [per, "source"], "left_semi").join(known.withColumnRenamed("name", "target"), [per, "target"], "left_semi")
    links = ends.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy("pos"))).filter(F.col("_n") <= EXTRACTION_CAPS["relationships"]).drop("_n")
    return capped, links


def budgeted(sections: dict[str, tuple[int, str]], limit: int, safety: int = 500, count=lambda t: len(t) // 4) -> dict[str, str]:
    """Texts of an answer within a token budget.

    ``sections``: name -> (priority group 0..3, text). Groups are served in order; in the first that does not
    fit, the rest of the budget is split evenly among its texts, and those of later groups pass as they are.
    """
    left = limit - safety
    out: dict[str, str] = {}
    groups: dict[int, list[str]] = {}
    for name, (group, _) in sections.items():
        groups.setdefault(group, []).append(name)
    over = False
    for group in sorted(groups):
        names = groups[group]
        need = sum(count(sections[n][1]) for n in names)
        if over or need <= left:
            out |= {n: sections[n][1] for n in names}
            left -= 0 if over else need
            continue
        share = max(left, 0) // len(names)
        for n in names:
            text = sections[n][1]
            out[n] = text if count(text) <= share else text[: max(0, int(len(text) * share / max(count(text), 1)))]
        over = True
    return out
