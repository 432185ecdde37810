"""Message routing: which path a chat message takes and what is answered without retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T


def reply_table(spark: SparkSession) -> DataFrame:
    """The fixed reply texts, one row per audience and kind."""
    return spark.createDataFrame(list(K.REPLIES), "audience string, kind string, reply string")


def route_messages(messages: DataFrame) -> DataFrame:
    """Add ``route``, ``action``, ``reason`` and ``reply`` to messages with ``role``, ``mode`` and ``text``.

    Patients are greeted, sent to a booking action or a schedule lookup, or refused as medical.  Clinicians are
    refused off-topic and patient-specific requests; everything else goes to retrieval.
    """
    patient = F.col("role") == "patient"
    labelled = messages.select(
        "*", T.classify_intent("text").alias("__intent"), T.greeting_type("text").alias("__greeting"),
        T.clearly_off_topic("text").alias("__off"), T.personal_request("text").alias("__personal"))
    intent = F.col("__intent")
    action = F.when(patient & intent.isin("book", "cancel", "reschedule"), intent)
    route = (
        F.when(patient, F.when(intent == "greeting", "greeting").when(action.isNotNull(), "action")
               .when(intent.isin("appointment", "availability"), "schedule").otherwise("refuse"))
        .when(F.col("__off") | F.col("__personal").isNotNull(), "refuse").otherwise("retrieve"))
    reason = (
        F.when(patient & (F.col("route") == "refuse"), "patient_medical_not_supported")
        .when(~patient & F.col("__off"), "non_medical_question")
        .when(~patient, F.col("__personal")))
    kind = (
        F.when(F.col("route") == "greeting", F.col("__greeting"))
        .when(F.col("route") == "action", F.col("action"))
        .when(F.col("reason").isin(*K.PERSONAL_REASONS), "personal").otherwise(F.col("reason")))
    routed = (
        labelled.withColumn("action", action).withColumn("route", route).withColumn("reason", reason)
        .withColumn("__kind", kind))
    replies = reply_table(messages.sparkSession).select(
        F.col("audience").alias("role"), F.col("kind").alias("__kind"), "reply")
    # Sixteen fixed rows: always small enough to broadcast.
    return routed.join(F.broadcast(replies), ["role", "__kind"], "left").select(
        *messages.columns, "route", "action", "reason", "reply")
