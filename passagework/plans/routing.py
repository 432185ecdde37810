"""Family F: message routing over conversations, every fourth kind of message written in."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.operators.routing import route_messages
from passagework.plans import sqltext as Q
from passagework.plans.registry import query
from passagework.sources.lineage import spread
from passagework.sources.tables import table

_PREFIX = (
    "Hello!", "please book an appointment tomorrow", "I must reschedule", "cancel my next visit",
    "which doctors are in", "when is my appointment", "do I have asthma", "best pizza place",
    "what dose should I take", "See you!", "")

# A greeting is a message of its own, whatever marks stand around it: it gets the marks of the whole text.
_MARKS = r"regexp_replace(text, '[\p{L}\p{N}\p{M}_]+', '', 'g')"
_CASES = " ".join(
    f"when {i} then {Q.lit(p)} || " + (_MARKS if p.endswith("!") else "' ' || text") for i, p in enumerate(_PREFIX))
_MSG = f"""with m as (select conv_id, turn, case when role = 'assistant' then 'doctor' else 'patient' end as role,
  case (conv_id * 3 + turn) % 11 {_CASES} end as text from conversations)"""


def messages(spark, sf):
    n = (F.col("conv_id") * 3 + F.col("turn")) % 11
    out = None
    for i, p in enumerate(_PREFIX):
        t = F.concat(F.lit(p), F.regexp_replace("text", r"[\p{L}\p{N}\p{M}_]+", "")) if p.endswith("!") else F.concat(F.lit(p + " "), F.col("text"))
        out = F.when(n == i, t) if out is None else out.when(n == i, t)
    return spread(table(spark, sf, "conversations"), "conv_id").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "doctor").otherwise("patient").alias("role"),
        F.lit("general").alias("mode"), out.alias("text"))


_NORM = "lower(" + Q.strip(f"regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}_{Q.WS[1:-1]}]', '', 'g')") + ")"
_GREET = "case " + " ".join(
    f"when {_NORM} in ({', '.join(Q.lit(p) for p in phrases)}) then '{kind}'" for kind, phrases in K.GREETINGS.items()) + " end"


def _re(p: str) -> str:
    return f"regexp_matches(text, {Q.lit(p)})"


_INTENT = (
    f"case when {_GREET} is not null then 'greeting' when {_re(K.RESCHEDULE)} then 'reschedule' "
    f"when {_re(K.CANCEL)} then 'cancel' when {_re(K.BOOK)} then 'book' when {_re(K.AVAILABILITY)} then 'availability' "
    f"when {_re(K.APPOINTMENT)} then 'appointment' else 'medical' end")
_PERSONAL = (
    f"case when regexp_matches({Q.squeeze('text')}, {Q.lit(K.PERSONAL_DIAGNOSIS)}) then '{K.PERSONAL_REASONS[0]}' "
    f"when regexp_matches({Q.squeeze('text')}, {Q.lit(K.PERSONAL_DOSAGE)}) then '{K.PERSONAL_REASONS[1]}' end")


def _label(name, fn, sql):
    @query(name, f"{_MSG} select conv_id, turn, {sql} as label from m")
    def run(spark, sf):
        return messages(spark, sf).select("conv_id", "turn", fn("text").alias("label"))
    return run


_label("f1_greeting_type", T.greeting_type, _GREET)
_label("f2_classify_intent", T.classify_intent, _INTENT)
_label("f3_personal_request", T.personal_request, _PERSONAL)
_label("f4_clearly_off_topic", T.clearly_off_topic, _re(K.OFF_TOPIC))


@query("f5_route_messages", f"""{_MSG},
l as (select *, {_GREET} as g, {_INTENT} as i, {_re(K.OFF_TOPIC)} as off, {_PERSONAL} as p from m),
r as (select *, case when role = 'patient' then case when i = 'greeting' then 'greeting'
      when i in ('book', 'cancel', 'reschedule') then 'action' when i in ('appointment', 'availability') then 'schedule'
      else 'refuse' end when off or p is not null then 'refuse' else 'retrieve' end as route,
    case when role = 'patient' and i in ('book', 'cancel', 'reschedule') then i end as action from l),
s as (select *, case when role = 'patient' and route = 'refuse' then 'patient_medical_not_supported'
    when role = 'doctor' and off then 'non_medical_question' when role = 'doctor' then p end as reason from r),
k as (select *, case when route = 'greeting' then g when route = 'action' then action
    when reason like 'patient_specific_%' then 'personal' else reason end as kind from s)
select conv_id, turn, route, action, reason, reply from k left join (values
  {', '.join('(' + ', '.join(Q.lit(x) for x in row) + ')' for row in K.REPLIES)}) t(audience, tk, reply)
  on t.audience = k.role and t.tk = k.kind""")
def route(spark, sf):
    return route_messages(messages(spark, sf)).select("conv_id", "turn", "route", "action", "reason", "reply")
