"""Family J: clinic operations.  Suppliers are doctors, customers patients, nations clinics, orders appointments,
events booking requests and reports, conversations chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import operations as O
from passagework.plans.registry import query
from passagework.plans.views import text_pages
from passagework.sources.tables import table

_DOCTORS = """dr as (select s_suppkey as doctor_id, s_nationkey as clinic_id, s_name as name,
  case when s_suppkey % 5 = 0 then 'off' else 'available' end as status from supplier)"""
_WINDOWS = """wd as (select s_suppkey as doctor_id, s_suppkey % 7 as day_of_week, '09:00:00' as start_time,
    '12:15:00' as end_time from supplier
  union all select s_suppkey, (s_suppkey + 3) % 7, '13:30:00', '17:00:00' from supplier)"""
_APPTS = """ap as (select o_orderkey as id, o_custkey as patient_id, o_orderkey % 97 + 1 as doctor_id,
  o_orderdate::timestamp as slot,
  case o_orderstatus when 'O' then 'booked' when 'F' then 'done' else 'cancelled' end as status from orders)"""
_CUST = """pt as (select c_custkey as patient_id, c_custkey % 97 + 1 as doctor_id, c_nationkey as clinic_id, c_name as name
  from customer)"""
_NOW = "2024-01-10 10:05:00"
_ORDER_NOW = "1995-06-01 00:00:00"


def doctors(spark, sf):
    n = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        n.alias("doctor_id"), F.col("s_nationkey").alias("clinic_id"), F.col("s_name").alias("name"),
        F.when(n % 5 == 0, "off").otherwise("available").alias("status"))


def windows(spark, sf):
    s, n = table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.select(n.alias("doctor_id"), (n % 7).alias("day_of_week"), F.lit("09:00:00").alias("start_time"),
                    F.lit("12:15:00").alias("end_time")).unionAll(
        s.select(n, (n + 3) % 7, F.lit("13:30:00"), F.lit("17:00:00")))


def appointments(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"),
        (F.col("o_orderkey") % 97 + 1).alias("doctor_id"), F.col("o_orderdate").cast("timestamp").alias("slot"),
        F.when(s == "O", "booked").when(s == "F", "done").otherwise("cancelled").alias("status"))


def patients(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 97 + 1).alias("doctor_id"),
        F.col("c_nationkey").alias("clinic_id"), F.col("c_name").alias("name"))


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _now(s):
    return F.lit(s).cast("timestamp")


_SLOTS = f"""{_DOCTORS}, {_WINDOWS},
dy as (select unnest(range(0, 14)) as k),
sw as (select w.doctor_id, (date '2024-01-10' + k::int) + w.start_time::time as s, (date '2024-01-10' + k::int) + w.end_time::time as e
  from wd w join dr using (doctor_id) cross join dy
  where dr.status = 'available' and isodow(date '2024-01-10' + k::int) - 1 = w.day_of_week),
sl as (select doctor_id, unnest(range(s, e, interval 30 minute)) as slot from sw),
slots as (select * from sl where slot > timestamp '{_NOW}')"""


@query("j1_generate_slots",
       f"with {_SLOTS} select doctor_id, strftime(slot, '%Y-%m-%d %H:%M:%S') as slot from slots")
def generate_slots(spark, sf):
    return O.generate_slots(doctors(spark, sf), windows(spark, sf), _now(_NOW)).select(
        "doctor_id", _text("slot").alias("slot"))


@query("j2_upcoming_appointments", f"""with {_DOCTORS}, {_APPTS},
r as (select *, row_number() over (partition by patient_id order by slot, id) as position from ap
  where status = 'booked' and slot >= timestamp '{_ORDER_NOW}')
select r.patient_id, r.id, position, strftime(slot, '%Y-%m-%d %H:%M:%S') as slot, dr.name as doctor_name
from r left join dr using (doctor_id) where position <= 10""")
def upcoming_appointments(spark, sf):
    return O.upcoming_appointments(appointments(spark, sf), doctors(spark, sf), _now(_ORDER_NOW)).select(
        "patient_id", "id", "position", _text("slot").alias("slot"), "doctor_name")


_REQUESTS = """rq as (select event_id, user_id % 97 + 1 as doctor_id,
  date_trunc('hour', ts) + (event_id % 2) * interval 30 minute as slot from events)"""


def _requests(spark, sf):
    e = table(spark, sf, "events")
    slot = F.date_trunc("hour", "ts") + F.make_dt_interval(mins=(F.col("event_id") % 2 * 30).cast("int"))
    return e.select("event_id", (F.col("user_id") % 97 + 1).alias("doctor_id"), slot.alias("slot"))


@query("j3_valid_slot_requests", f"""with {_SLOTS}, {_REQUESTS}
select event_id, case when rq.slot <= timestamp '{_NOW}' then 'not_future' when s.slot is null then 'not_a_slot' end as reason
from rq left join (select distinct doctor_id, slot from slots) s on s.doctor_id = rq.doctor_id and s.slot = rq.slot""")
def valid_slot_requests(spark, sf):
    slots = O.generate_slots(doctors(spark, sf), windows(spark, sf), _now(_NOW))
    return O.valid_slot_requests(_requests(spark, sf), slots, _now(_NOW)).select("event_id", "reason")


_BOOKINGS = """bk as (select event_id as id, user_id as doctor_id, date_trunc('hour', ts) as slot, ts as created_at,
  case when event_type in ('view', 'click') then 'cancelled' else 'booked' end as status from events)"""


def _bookings(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("doctor_id"), F.date_trunc("hour", "ts").alias("slot"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type").isin("view", "click"), "cancelled").otherwise("booked").alias("status"))


@query("j4_double_bookings", f"""with {_BOOKINGS} select doctor_id, strftime(slot, '%Y-%m-%d %H:%M:%S') as slot,
  count(*) as bookings from bk where status = 'booked' group by all having count(*) > 1""")
def double_bookings(spark, sf):
    return O.double_bookings(_bookings(spark, sf)).select("doctor_id", _text("slot").alias("slot"), "bookings")


@query("j4_first_wins", f"""with {_BOOKINGS}, r as (select *, row_number() over
  (partition by doctor_id, slot order by created_at, id) as k from bk where status = 'booked')
select doctor_id, strftime(slot, '%Y-%m-%d %H:%M:%S') as slot, id from r where k = 1""")
def first_wins(spark, sf):
    return O.first_wins(_bookings(spark, sf)).select("doctor_id", _text("slot").alias("slot"), "id")


# One step per action and clinic, with the booked places as a list; appointments outside the actions' slots cannot matter.
_FOLD = f"""{_APPTS},
ac as (select (user_id % 25)::int as clinic_id, event_id as action_id, case event_type when 'error' then 'cancel'
      when 'click' then 'reschedule' else 'book' end as action, event_id % 211 as appt, user_id as doctor_id,
    date_trunc('day', ts)::timestamp as slot, row_number() over (partition by user_id % 25 order by ts, event_id) as n from events),
st as (select clinic_id, 0::bigint as n, (select list({{'a': (id + 1000000000)::bigint, 'd': doctor_id::bigint, 's': slot}}) from ap
      where status = 'booked' and patient_id % 25 = c.clinic_id and slot in (select slot from ac)) as held,
    null::bigint as action_id, null::varchar as action, null::bigint as appt, null::varchar as reason
  from (select distinct clinic_id from ac) c
  union all
  select q.clinic_id, q.n, case when q.reason is not null then q.held
      when q.action = 'cancel' then list_filter(q.held, lambda x: x.a <> q.appt)
      else list_append(list_filter(q.held, lambda x: x.a <> q.appt), {{'a': q.appt, 'd': q.doctor_id, 's': q.slot}}) end,
    q.action_id, q.action, q.appt, q.reason
  from (select a.*, coalesce(s.held, []) as held, case
      when a.action <> 'book' and len(list_filter(coalesce(s.held, []), lambda x: x.a = a.appt)) = 0 then 'not_available_to_' || a.action
      when a.action <> 'cancel' and len(list_filter(coalesce(s.held, []), lambda x: x.d = a.doctor_id and x.s = a.slot and x.a <> a.appt)) > 0
        then 'slot_taken'
      when a.action = 'book' and len(list_filter(coalesce(s.held, []), lambda x: x.a = a.appt)) > 0 then 'already_booked' end as reason
    from st s join ac a on a.clinic_id = s.clinic_id and a.n = s.n + 1) q)"""


@query("j5_apply_booking_actions", f"""with recursive {_FOLD}
select action_id, action, appt as appointment_id, reason is null as applied, reason from st where n > 0""")
def apply_booking_actions(spark, sf):
    e = table(spark, sf, "events")
    clinic = (F.col("user_id") % 25).cast("int")
    kind = F.col("event_type")
    slot = F.date_trunc("day", "ts")
    actions = e.select(
        clinic.alias("clinic_id"), F.col("ts").alias("at"), F.col("event_id").alias("action_id"),
        F.when(kind == "purchase", "book").when(kind == "error", "cancel").when(kind == "click", "reschedule").otherwise(
            "book").alias("action"),
        (F.col("event_id") % 211).alias("appointment_id"), F.col("user_id").alias("doctor_id"), slot.alias("slot"))
    booked = appointments(spark, sf).filter(F.col("status") == "booked").select(
        (F.col("patient_id") % 25).cast("int").alias("clinic_id"), (F.col("id") + 1_000_000_000).alias("id"),
        F.col("doctor_id"), "slot", "status")
    return O.apply_booking_actions(booked, actions).drop("clinic_id")


@query("j6_available_now", f"""with {_DOCTORS}, {_WINDOWS},
f as (select dr.*, exists (select 1 from wd where wd.doctor_id = dr.doctor_id and day_of_week = 2
    and start_time <= '10:05:00' and '10:05:00' < end_time) as active from dr where status = 'available'),
g as (select *, bool_or(active) over (partition by clinic_id) as any_on from f)
select clinic_id, doctor_id, name, active from g where active or not any_on""")
def available_now(spark, sf):
    return O.available_now(doctors(spark, sf), windows(spark, sf), _now(_NOW)).select(
        "clinic_id", "doctor_id", "name", "active")


@query("j7_patients_per_doctor", f"""with {_DOCTORS}, {_CUST}
select dr.doctor_id, dr.name, count(pt.patient_id) as patients from dr left join pt using (doctor_id) group by all""")
def patients_per_doctor(spark, sf):
    return O.patients_per_doctor(doctors(spark, sf), patients(spark, sf))


@query("j7_staffing_totals",
       "select (select count(*) from supplier) as doctors, (select count(*) from customer) as patients")
def staffing_totals(spark, sf):
    return O.staffing_totals(doctors(spark, sf), patients(spark, sf))


@query("j8_clinic_stats", """with c as (select n_nationkey as clinic_id, n_name as clinic_name from nation where n_nationkey <> 0),
s as (select clinic_id, clinic_name, (select count(*) from supplier where s_nationkey = clinic_id) as doctor_count,
  (select count(*) from customer where c_nationkey = clinic_id) as patient_count,
  (select count(*) from documents where doc_id % 25 = clinic_id) as document_count from c)
select clinic_id, clinic_name, doctor_count, patient_count, document_count from s
union all select null, null, sum(doctor_count)::bigint, sum(patient_count)::bigint, sum(document_count)::bigint from s""")
def clinic_stats(spark, sf):
    clinics = table(spark, sf, "nation").select(F.col("n_nationkey").alias("clinic_id"), F.col("n_name").alias("clinic_name"))
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 25).cast("int").alias("clinic_id"))
    return O.clinic_stats(clinics, doctors(spark, sf), patients(spark, sf), docs, sentinel=0)


@query("j9_session_list", """with s as (select user_id as session_id, min(ts) as started_at from events group by 1),
m as (select conv_id as session_id, count(*) as message_count from conversations group by 1)
select session_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') as started_at, message_count from s join m using (session_id)""")
def session_list(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started_at"))
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"))
    return O.session_list(s, m).select("session_id", _text("started_at").alias("started_at"), "message_count")


@query("j10_transcripts", """select conv_id as session_id,
  string_agg(role || ': ' || text, chr(10) order by turn) as transcript from conversations group by 1""")
def transcripts(spark, sf):
    m = table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")
    return O.transcripts(m).select("session_id", F.array_join(
        F.transform("messages", lambda x: F.concat(x.role, F.lit(": "), x.text)), "\n").alias("transcript"))


_REPORTS = """rp as (select event_id as report_id, ts as created_at, case when event_id % 3 = 0 then 'resolved' else 'open' end
  as status, case when event_id % 3 = 0 then ts end as resolved_at from events where event_type = 'error')"""


def _reports(spark, sf):
    solved = F.col("event_id") % 3 == 0
    return table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("report_id"), F.col("ts").alias("created_at"),
        F.when(solved, "resolved").otherwise("open").alias("status"), F.when(solved, F.col("ts")).alias("resolved_at"))


@query("j11_bug_report_queue", f"""with {_REPORTS}
select report_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, status from rp""")
def bug_report_queue(spark, sf):
    return O.bug_report_queue(_reports(spark, sf)).select("report_id", _text("created_at").alias("created_at"), "status")


@query("j11_set_status", f"""with {_REPORTS}, u as (select event_id as report_id,
    case event_id % 4 when 0 then 'investigating' when 1 then 'resolved' else 'open' end as s from events
  where event_id % 5 <> 0)
select report_id, coalesce(s, status) as status, strftime(case when s is null then resolved_at
  when s = 'resolved' then timestamp '{_NOW}' end, '%Y-%m-%d %H:%M:%S') as resolved_at from rp left join u using (report_id)""")
def set_status(spark, sf):
    n = F.col("event_id")
    u = table(spark, sf, "events").filter(n % 5 != 0).select(
        n.alias("report_id"), F.when(n % 4 == 0, "investigating").when(n % 4 == 1, "resolved").otherwise("open").alias(
            "status"), _now(_NOW).alias("at"))
    u = u.unionByName(u.filter("report_id % 3 = 0").select(
        "report_id", F.lit("resolved").alias("status"), (F.col("at") - F.expr("interval 1 hour")).alias("at")))
    return O.set_status(_reports(spark, sf), u).select("report_id", "status", _text("resolved_at").alias("resolved_at"))


@query("j12_document_stage_status", """with d as (select doc_id, length(text) // 850 + 1 as chunk_count,
  case when doc_id % 9 = 0 then 'no text in ' || substr(text, 1, 2000) end as ie, case when doc_id % 7 = 0 then 'index down' end as re,
  doc_id % 5 as hit_count, case when doc_id % 4 = 0 then 'model down' end as ge, doc_id % 2 = 0 as grounded from documents),
s as (select *, case when ie is null then 'ok' else 'error' end as i,
  case when ie is not null then 'not_reached' when re is null then 'ok' else 'error' end as r from d)
select doc_id::varchar as document_id, i as indexing_status, substr(ie, 1, 1000) as indexing_error, chunk_count,
  r as retrieval_status, re as retrieval_error, hit_count,
  case when r <> 'ok' then 'not_reached' when ge is null then 'ok' else 'error' end as generation_status,
  ge as generation_error, grounded from s""")
def document_stage_status(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    key = n.cast("string").alias("document_id")
    indexing = d.select(key, F.floor(F.length("text") / 850 + 1).alias("chunk_count"), F.when(
        n % 9 == 0, F.concat(F.lit("no text in "), F.substring("text", 1, 2000))).alias("error"))
    retrieval = d.select(key, (n % 5).alias("hit_count"), F.when(n % 7 == 0, F.lit("index down")).alias("error"))
    generation = d.select(key, (n % 2 == 0).alias("grounded"), F.when(n % 4 == 0, F.lit("model down")).alias("error"))
    return O.document_stage_status(d.select(key), indexing, retrieval, generation)


@query("j12_stage_samples", """with c as (select source || '-' || (doc_id // 1000) as document_id, doc_id,
  row_number() over (partition by source || '-' || (doc_id // 1000) order by doc_id) as k, text from documents)
select document_id, k as sample, 'd' || doc_id as chunk_id, k as page_number, 'Section' as section_title,
  substr(text, 1, 600) as text from c where k <= 3""")
def stage_samples(spark, sf):
    p = text_pages(spark, sf)
    return O.stage_samples(p.select(
        "document_id", F.col("page_number").alias("chunk_index"), "page_number",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("Section").alias("section_title"),
        "text"))


# Callers: every doctor and patient, one administrator per clinic.
_CALLERS = f"""{_DOCTORS}, {_CUST}, {_APPTS},
ca as (select 'd' || doctor_id as caller_id, 'doctor' as role, clinic_id, doctor_id as me_d, null::bigint as me_p from dr
  union all select 'p' || patient_id, 'patient', clinic_id, null, patient_id from pt
  union all select 'a' || n_nationkey, 'admin', n_nationkey, null, null from nation),
aq as (select ap.*, pt.clinic_id from ap join pt using (patient_id))"""


def callers(spark, sf):
    none = F.lit(None).cast("bigint")
    d, p = doctors(spark, sf), patients(spark, sf)
    return d.select(
        F.concat(F.lit("d"), F.col("doctor_id").cast("string")).alias("caller_id"), F.lit("doctor").alias("role"),
        "clinic_id", "doctor_id", none.alias("patient_id")).unionByName(p.select(
            F.concat(F.lit("p"), F.col("patient_id").cast("string")).alias("caller_id"), F.lit("patient").alias("role"),
            "clinic_id", none.alias("doctor_id"), "patient_id")).unionByName(table(spark, sf, "nation").select(
                F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("caller_id"),
                F.lit("admin").alias("role"), F.col("n_nationkey").alias("clinic_id"), none.alias("doctor_id"),
                none.alias("patient_id")))


def _clinic_appointments(spark, sf):
    return appointments(spark, sf).join(patients(spark, sf).select("patient_id", "clinic_id"), "patient_id")


@query("j13_visible_patients", f"""with {_CALLERS}
select caller_id, pt.patient_id from ca join pt on ca.clinic_id = pt.clinic_id
where role = 'admin' or me_p = pt.patient_id or (role = 'doctor' and me_d = pt.doctor_id)""")
def visible_patients(spark, sf):
    return O.visible_rows("patients", patients(spark, sf), callers(spark, sf)).select("caller_id", "patient_id")


@query("j13_visible_appointments", f"""with {_CALLERS}
select caller_id, aq.id from ca join aq on ca.clinic_id = aq.clinic_id
where role = 'admin' or me_p = aq.patient_id or (role = 'doctor' and me_d = aq.doctor_id)""")
def visible_appointments(spark, sf):
    return O.visible_rows("appointments", _clinic_appointments(spark, sf), callers(spark, sf)).select("caller_id", "id")


@query("j13_visible_records", f"""with {_CALLERS}
select caller_id, aq.id from ca join aq on ca.clinic_id = aq.clinic_id join pt on pt.patient_id = aq.patient_id
where me_p = aq.patient_id or (role = 'doctor' and me_d = pt.doctor_id)""")
def visible_records(spark, sf):
    records = _clinic_appointments(spark, sf).select("id", "patient_id", "clinic_id")
    return O.visible_rows("records", records, callers(spark, sf), patients(spark, sf)).select("caller_id", "id")


_DOCS = """dc as (select doc_id as document_id, (doc_id % 25)::int as clinic_id, case when quality is null then 'processing' else 'ready' end
  as status, coalesce(quality = 1, false) as verified from documents left join labels using (doc_id))"""


def _documents(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("document_id"), (F.col("doc_id") % 25).cast("int").alias("clinic_id"),
        F.when(F.col("quality").isNull(), "processing").otherwise("ready").alias("status"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("verified"), F.col("doc_id").alias("uploaded_at"))


@query("j13_visible_documents", f"""with {_CALLERS}, {_DOCS}
select role, document_id, count(*) as callers from ca join dc on ca.clinic_id = dc.clinic_id
where role = 'doctor' or (role = 'patient' and status = 'ready' and verified) group by all""")
def visible_documents(spark, sf):
    return O.caller_counts("documents", _documents(spark, sf), callers(spark, sf)).select("role", "document_id", "callers")


@query("j13_document_inventory", f"""with {_CALLERS}, {_DOCS}
select caller_id, document_id from ca join dc on ca.clinic_id = dc.clinic_id
where role = 'doctor' or (role = 'patient' and status = 'ready' and verified)""")
def document_inventory(spark, sf):
    return O.document_inventory(_documents(spark, sf), callers(spark, sf), ordered=False).select("caller_id", "document_id")


@query("j13_visible_chunks", f"""with {_CALLERS}, {_DOCS}, ck as (select conv_id, turn, conv_id as document_id,
  ((conv_id + (conv_id % 7 = 0)::int) % 25)::int as clinic_id from conversations)
select caller_id, conv_id, turn from ca join ck on ca.clinic_id = ck.clinic_id left join dc on dc.document_id = ck.document_id
where role = 'doctor' or (role = 'patient' and dc.status = 'ready' and dc.verified and dc.clinic_id = ca.clinic_id)""")
def visible_chunks(spark, sf):
    chunks = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("conv_id").alias("document_id"),
        ((F.col("conv_id") + (F.col("conv_id") % 7 == 0).cast("int")) % 25).cast("int").alias("clinic_id"))
    return O.visible_rows("chunks", chunks, callers(spark, sf), _documents(spark, sf)).select("caller_id", "conv_id", "turn")


_CHAT = """ms as (select conv_id as session_id, turn, pt.patient_id, pt.doctor_id, pt.clinic_id
  from conversations join pt on pt.patient_id = conv_id % 150 + 1)"""


def _chat(spark, sf):
    return table(spark, sf, "conversations").withColumn("patient_id", F.col("conv_id") % 150 + 1).join(
        patients(spark, sf), "patient_id").select(F.col("conv_id").alias("session_id"), "turn", "patient_id", "doctor_id",
                                                  "clinic_id")


@query("j13_visible_messages", f"""with {_CALLERS}, {_CHAT}
select 'patient chat' as chat, caller_id, session_id, turn from ca join ms on ca.clinic_id = ms.clinic_id and me_p = ms.patient_id
union all select 'doctor chat', caller_id, session_id, turn from ca join ms on ca.clinic_id = ms.clinic_id
  and role = 'doctor' and me_d = ms.doctor_id and session_id % 6 <> 0""")
def visible_messages(spark, sf):
    chat = _chat(spark, sf)
    rows = chat.select("session_id", "turn", "clinic_id")
    other = F.col("clinic_id") + (F.col("session_id") % 6 == 0).cast("int")  # every sixth session is another clinic's
    sessions = chat.select("session_id", "patient_id", "doctor_id", other.alias("clinic_id")).distinct()
    who = callers(spark, sf)

    def seen(kind, label):
        return O.visible_rows(kind, rows, who, sessions).select(F.lit(label).alias("chat"), "caller_id", "session_id", "turn")

    return seen("messages", "patient chat").unionAll(seen("doctor_messages", "doctor chat"))


@query("j13_visible_operations", f"""with {_CALLERS}, {_WINDOWS}, wc as (select wd.*, clinic_id from wd join dr using (doctor_id)),
rp as (select event_id, (user_id % 25)::int as clinic_id from events where event_type = 'error'),
lg as (select event_id, 'i' || (user_id % 3) as it_user_id from events where event_type = 'view')
select 'availability' as kind, caller_id, count(*) as n from ca join wc on ca.clinic_id = wc.clinic_id group by caller_id
union all select 'reports', caller_id, count(*) from ca join rp on ca.clinic_id = rp.clinic_id where role = 'doctor' group by caller_id
union all select 'access_log', it_user_id, count(*) from lg group by it_user_id""")
def visible_operations(spark, sf):
    who, e = callers(spark, sf), table(spark, sf, "events")
    w = windows(spark, sf).join(doctors(spark, sf).select("doctor_id", "clinic_id"), "doctor_id")
    reports = e.filter(F.col("event_type") == "error").select("event_id", (F.col("user_id") % 25).cast("int").alias("clinic_id"))
    log = e.filter(F.col("event_type") == "view").select(
        "event_id", F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")).alias("it_user_id"))
    none = F.lit(None).cast("bigint")
    it = log.select(F.col("it_user_id").alias("caller_id")).distinct().select(
        "caller_id", F.lit("it").alias("role"), F.lit(None).cast("int").alias("clinic_id"), none.alias("doctor_id"),
        none.alias("patient_id"))
    out = None
    for kind, rows, c in (("availability", w, who), ("reports", reports, who), ("access_log", log, it)):
        part = O.visible_counts(kind, rows, c).select(F.lit(kind).alias("kind"), "caller_id", "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("j14_protected_column_changes", """select c_custkey as patient_id, concat_ws(',',
  case when c_custkey % 4 = 0 then 'doctor_id' end, case when c_custkey % 6 = 0 then 'clinic_id' end) as changed
from customer where c_custkey % 4 = 0 or c_custkey % 6 = 0""")
def protected_column_changes(spark, sf):
    before = patients(spark, sf).withColumn("auth_id", F.col("name"))
    n = F.col("patient_id")
    after = before.withColumn("doctor_id", F.when(n % 4 == 0, F.col("doctor_id") + 1).otherwise(F.col("doctor_id"))).withColumn(
        "clinic_id", F.when(n % 6 != 0, F.col("clinic_id")))
    return O.protected_column_changes(before, after, "patient_id").select(
        "patient_id", F.array_join("changed", ",").alias("changed"))


@query("j15_constraint_violations", f"""with o as (select o_orderkey, floor(o_totalprice / 1000)::int as age,
    case o_orderpriority when '1-URGENT' then 'booked' when '2-HIGH' then 'urgent' else 'done' end as status from orders)
select 'patients' as tab, o_orderkey as id, 'age_range' as rule from o where not (age between 0 and 130)
union all select 'appointments', o_orderkey, 'status' from o where status = 'urgent'
union all select 'windows', l_orderkey * 10 + l_linenumber, 'weekday' from lineitem where l_linenumber > 6
union all select 'windows', l_orderkey * 10 + l_linenumber, 'end_after_start' from lineitem where l_discount <= l_tax
union all select 'documents', doc_id, 'verified_requires_ready' from documents where doc_id % 3 = 0 and doc_id % 2 = 0
union all select 'documents', doc_id, 'sha256_format' from documents where doc_id % 5 = 0
union all select 'bug_reports', event_id, 'resolution_consistency' from events where event_type = 'error' and event_id % 2 = 0
union all select 'bug_reports', event_id, 'status' from events where event_type = 'view'""")
def constraint_violations(spark, sf):
    rules = O.schema_rules()
    price, p = F.col("o_totalprice"), F.col("o_orderpriority")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(price / 1000).cast("int").alias("age"),
        F.when(p == "1-URGENT", "booked").when(p == "2-HIGH", "urgent").otherwise("done").alias("status"))
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("day_of_week"),
        F.col("l_tax").alias("start_time"), F.col("l_discount").alias("end_time"))
    n = F.col("doc_id")
    sha = F.sha2("text", 256)
    d = table(spark, sf, "documents").select(
        n.alias("id"), F.when(n % 3 == 0, "failed").otherwise("ready").alias("status"), (n % 2 == 0).alias("verified"),
        F.when(n % 5 == 0, F.upper(F.concat(F.lit("x"), sha))).when(n % 7 != 0, sha).alias("file_sha256"))
    e = F.col("event_id")
    kind = F.col("event_type")
    b = table(spark, sf, "events").select(
        e.alias("id"), F.lit("issue").alias("issue"),
        F.when(kind == "error", "resolved").when(kind == "view", "closed").otherwise("open").alias("status"),
        F.when((kind == "error") & (e % 2 != 0), F.col("ts")).alias("resolved_at"))
    out = None
    for name, rows in (("patients", o), ("appointments", o), ("windows", li), ("documents", d), ("bug_reports", b)):
        part = O.constraint_violations(rows, "id", rules[name]).select(F.lit(name).alias("tab"), "id", "rule")
        out = part if out is None else out.unionAll(part)
    return out


@query("j16_assign_doctor", f"""with {_DOCTORS}, {_CUST}, cl as (select clinic_id, count(*) as n, min(doctor_id) as sole from dr group by 1),
rq as (select patient_id, case when clinic_id = 3 then 99 else clinic_id end as clinic_id,
    case when patient_id % 3 = 0 then null else doctor_id end as doctor_id from pt),
j as (select rq.*, n, sole, exists (select 1 from dr where dr.doctor_id = rq.doctor_id and dr.clinic_id = rq.clinic_id) as member
  from rq left join cl using (clinic_id)),
e as (select *, case when n is null then 'no_doctor_registered' when doctor_id is not null and not member then 'doctor_not_in_clinic'
  when doctor_id is null and n > 1 then 'choose_doctor' end as error from j)
select patient_id, error, case when error is null then coalesce(doctor_id, sole) end as assigned_doctor_id from e""")
def assign_doctor(spark, sf):
    p = patients(spark, sf).withColumn("clinic_id", F.when(F.col("clinic_id") == 3, F.lit(99)).otherwise(
        F.col("clinic_id"))).withColumn("doctor_id", F.when(F.col("patient_id") % 3 != 0, F.col("doctor_id")))
    return O.assign_doctor(p, doctors(spark, sf)).select("patient_id", "error", "assigned_doctor_id")


@query("j17_relabel_modes", """select event_id, case when event_type = 'signup' then 'general' else event_type end as mode from events""")
def relabel_modes(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("mode"))
    return O.relabel_modes(e, "mode", "signup", "general")


@query("j18_orphan_rows", """select l_orderkey, l_linenumber from lineitem where not exists
  (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')""")
def orphan_rows(spark, sf):
    kept = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    return O.orphan_rows(table(spark, sf, "lineitem"), kept, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")
