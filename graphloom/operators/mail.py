"""Messages: threads, persons, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def threads(messages: DataFrame) -> DataFrame:
    """(uid, thread): messages (uid, message_id, in_reply_to, refs) that share ids, directly or through others,
    by the smallest uid of the thread; only threads of two and more. A message that links two groups merges them."""
    ids = F.filter(F.concat(F.array("message_id", "in_reply_to"), F.coalesce("refs", F.array())), lambda x: x.isNotNull())
    links = cut(messages.select("uid", F.explode(F.array_distinct(ids)).alias("id")))
    labels = messages.select("uid", F.col("uid").alias("thread"))
    while True:
        by_id = links.join(labels, "uid").groupBy("id").agg(F.min("thread").alias("low"))
        low = links.join(by_id, "id").groupBy("uid").agg(F.min("low").alias("low"))
        step = cut(labels.join(low, "uid", "left").select("uid", F.col("thread").alias("was"), F.least("thread", "low").alias("thread")))
        # pointer jumping: the label's own label
        step = cut(step.join(step.select(F.col("uid").alias("thread"), F.col("thread").alias("root")), "thread", "left").select("uid", "was", F.least("thread", F.coalesce("root", "thread")).alias("thread")))
        labels = step.select("uid", "thread")
        if step.where("was <> thread").isEmpty():
            break
    return labels.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("thread"))).where("n > 1").select("uid", "thread")


def replies(messages: DataFrame) -> DataFrame:
    """(source_uid, target_uid): a message and the one that it answers."""
    return messages.select(F.col("uid").alias("source_uid"), F.col("in_reply_to").alias("id")).join(messages.select(F.col("uid").alias("target_uid"), F.col("message_id").alias("id")), "id").select("source_uid", "target_uid")


def persons(messages: DataFrame) -> DataFrame:
    """(address, kind, uid): one normalised address per person; kind SENT_BY, or RECEIVED_BY for to and cc."""
    plain = lambda c: F.lower(F.trim(c))
    sent = messages.select(plain(F.col("sender")).alias("address"), F.lit("SENT_BY").alias("kind"), "uid")
    got = messages.select(F.explode(F.array_distinct(F.transform(F.concat(F.coalesce("to", F.array()), F.coalesce("cc", F.array())), plain))).alias("address"), F.lit("RECEIVED_BY").alias("kind"), "uid")
    return sent.unionByName(got).where("address <> ''")


def person_activity(messages: DataFrame) -> DataFrame:
    """(address, sent, received) of every person."""
    return persons(messages).groupBy("address").agg(F.count_if(F.col("kind") == "SENT_BY").alias("sent"), F.count_if(F.col("kind") == "RECEIVED_BY").alias("received"))


def search(messages: DataFrame, word: str, person: str | None = None, limit: int | None = 20) -> DataFrame:
    """Messages with a word in subject or body, of or to a person if one is given."""
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(word.lower())
    found = messages.where(has("subject") | has("body"))
    if person:
        found = found.join(persons(messages).where(F.col("address") == person.lower().strip()).select("uid").distinct(), "uid", "left_semi")
    return found.orderBy("uid").limit(limit) if limit else found
