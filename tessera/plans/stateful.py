"""Keyed state in batch form: limits, quotas, jobs and their lineage over ``events``.

The streaming forms are in ``tessera.streaming``; tests hold both against each other.
"""

from __future__ import annotations

from tessera.plans.dialect import Book

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS


@book.both("STR1 STR3 STR4")
def fixed_window_limit(d):
    """Three calls a user and day: later ones are refused and use nothing up."""
    return f"""
    WITH k AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM {d.t('events')})
    SELECT user_id, CAST(day AS VARCHAR(10)) AS day, count(*) AS asked, {d.i('sum(CASE WHEN k <= 3 THEN 1 ELSE 0 END)')} AS allowed, {d.i('greatest(3 - max(k), 0)')} AS remaining FROM k GROUP BY user_id, day"""


@book.both("STR5 STR6 STR2")
def daily_quota(d):
    """Tokens reserved (100 each) and settled by use a user and day, the rest refunded, never below zero."""
    return f"""
    SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, 100 * count(*) AS reserved, {d.i('sum(least(CAST(floor(value) AS BIGINT), 100))')} AS used, {d.i('greatest(100 * count(*) - sum(least(CAST(floor(value) AS BIGINT), 100)), 0)')} AS refunded
    FROM {d.t('events')} GROUP BY user_id, CAST(ts AS DATE)"""


@book.both("STR7")
def concurrency_slots(d):
    """The most leases of a user that overlap, each a day long: starts add one, ends take one away."""
    return f"""
    WITH e AS (SELECT user_id, {d.micros('ts')} AS t, 1 AS x FROM {d.t('events')} UNION ALL SELECT user_id, {d.micros('ts')} + 86400000000, -1 FROM {d.t('events')}),
    s AS (SELECT user_id, sum(x) OVER (PARTITION BY user_id ORDER BY t, x ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT user_id, {d.i('max(n)')} AS most FROM s GROUP BY user_id"""


@book.both("STR8")
def idempotent_first(d):
    """The first event of each user, type and key of its properties; later ones are repeats."""
    return f"""
    WITH k AS (SELECT event_id, user_id, event_type, {d.json('props', 'k')} AS k, ts FROM {d.t('events')})
    SELECT event_id, user_id, event_type, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts, event_id) AS rn FROM k) x WHERE rn = 1"""


@book.both("STR9 FLT18 FLT19")
def job_latest_state(d):
    """The last event of each user as its state, with its age at the end of the data and whether it is stalled (over a day old)."""
    return f"""
    WITH l AS (SELECT user_id, event_type, event_id, {d.micros('ts')} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {d.t('events')}), e AS (SELECT max({d.micros('ts')}) AS now FROM {d.t('events')})
    SELECT user_id, event_type AS state, event_id, round({d.d('now - t')} / 1000000, 3) AS age, now - t > 86400000000 AS stalled FROM l JOIN e ON true WHERE k = 1"""


@book.both("STR10")
def retry_lineage(d):
    """Repeated keys of a user as retries: the attempt and the event that each one retries."""
    return f"""
    WITH k AS (SELECT event_id, user_id, {d.json('props', 'k')} AS k, ts FROM {d.t('events')})
    SELECT event_id, {d.i('row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id)')} AS attempt, coalesce(lag(event_id) OVER (PARTITION BY user_id, k ORDER BY ts, event_id), -1) AS retry_of FROM k"""


@book.both("STR14")
def superseded_writes(d):
    """Writes that arrive (by event id) after a newer one (by time) of their user: refused; the last accepted wins."""
    return f"""
    WITH w AS (SELECT user_id, event_id, {d.micros('ts')} AS t, max({d.micros('ts')}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM {d.t('events')})
    SELECT user_id, {d.i('sum(CASE WHEN t < newest THEN 1 ELSE 0 END)')} AS refused, {d.i('sum(CASE WHEN t < newest THEN 0 ELSE 1 END)')} AS accepted FROM w GROUP BY user_id"""


@book.both("STR15")
def expired_cleanup(d):
    """Inputs older than ten days at the end of the data, by type."""
    return f"""
    WITH e AS (SELECT max({d.micros('ts')}) AS now FROM {d.t('events')})
    SELECT event_type, count(*) AS expired FROM {d.t('events')} x JOIN e ON true WHERE now - {d.micros('x.ts')} > 864000000000 GROUP BY event_type"""


@book.both("")
def log_fields(d):
    """Allowed fields of each event as one record, nulls left out, by type: how many, and a digest over those of blocks of 1,000 ids."""
    return f"""
    WITH b AS (SELECT event_type, floor(event_id / 1000) AS block, count(*) AS n, {d.sha(d.listed("event_id || '|' || user_id", ',', 'event_id'))} AS h FROM {d.t('events')} WHERE user_id IS NOT NULL GROUP BY event_type, floor(event_id / 1000))
    SELECT event_type, {d.i('sum(n)')} AS n, {d.sha(d.listed('h', ',', 'block'))} AS digest FROM b GROUP BY event_type"""


@book.both("2.21")
def sessions(d):
    """Sessions of each user with gaps of 12 hours at most (beyond the blueprint's own operators)."""
    return f"""
    WITH g AS (SELECT user_id, {d.micros('ts')} AS t, value, CASE WHEN {d.micros('ts')} - lag({d.micros('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END AS starts FROM {d.t('events')}),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, {d.i('session')} AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""
