"""Schemas of the tables.  Never inferred: an unknown is NULL, not a new type."""

from __future__ import annotations

PAGES = (
    "url string, run_id string, fetched_at timestamp, ok boolean, status int, "
    "content_type string, html string, final_url string, bytes long, error string"
)
LINK = "provenance string, verifiedAtISO string, verifiedNote string"
SOURCE = (
    f"url string, {LINK}, coopConfirmed boolean, type string, checkFrequencyHours int, "
    "renderMode string, browserRetryInCI boolean, renderModeNote string"
)
APPLY_VIA = "method string, target string, provenance string, verifiedAtISO string, note string"
ORGANISATIONS = (
    "id string, nameAr string, nameEn string, sector string, city array<string>, tier string, "
    "requiresZeroCourses struct<value:boolean,provenance:string,quote:string,sourceUrl:string>, "
    "acceptsUserMajor boolean, offersCoopProduct boolean, "
    "stipend struct<amountSAR:double,provenance:string,note:string>, "
    "flexibility string, intakeSize string, trainingQuality string, "
    "sources array<struct<url:string,provenance:string,verifiedAtISO:string,verifiedNote:string,"
    "coopConfirmed:boolean,type:string,checkFrequencyHours:int,renderMode:string,"
    "browserRetryInCI:boolean,renderModeNote:string>>, "
    "applyVia struct<method:string,target:string,provenance:string,verifiedAtISO:string,note:string>, "
    "manualCheckUrl struct<url:string,provenance:string,verifiedAtISO:string,verifiedNote:string>, "
    "historicalWindows array<struct<seasonLabel:string,openedISO:string,closedISO:string,provenance:string>>, "
    "notes string, importSource string"
)
AGGREGATORS = (
    "id string, nameAr string, "
    "link struct<url:string,provenance:string,verifiedAtISO:string,verifiedNote:string>, "
    "applyVia struct<method:string,target:string,provenance:string,verifiedAtISO:string,note:string>, "
    "weight double, checkFrequencyHours int, note string"
)
SNAPSHOTS = (
    "url string, org_id string, content_hash string, block_hashes array<string>, "
    "extracted_chars int, extraction_method string, first_seen timestamp, last_changed timestamp, "
    "thin_runs int, pending boolean, settled_without_verdict string, judge_failures int"
)
# The stream form also remembers when each page was last read.
STREAM_SNAPSHOTS = SNAPSHOTS + ", last_attempt timestamp"
HEALTH = (
    "url string, last_attempt timestamp, last_success timestamp, "
    "consecutive_failures long, last_error string, state string"
)
FETCH_LOG = "url string, fetched_at timestamp, seq long, ok boolean, error string"
RECORDS = (
    "id string, org_id string, title string, detected timestamp, first_seen timestamp, "
    "last_confirmed timestamp, status string, opens date, closes date, closes_hijri string, "
    "product string, majors array<string>, seats int, stipend_sar double, duration_weeks double, "
    "cities array<string>, score int, reason string, states_zero_courses_rule boolean, "
    "zero_courses_quote string, flags array<string>, url string, apply_url string, excerpt string"
)
NOTICES = (
    "reader_id long, key string, kind string, title string, body string, weight double, "
    "announcement string, queued_at timestamp"
)
NOTICE_LOG = "reader_id long, key string, sent_at timestamp, via string"
SCHEDULE = "url string, org_id string, tier string, next_check timestamp, last_checked timestamp"
ATTEMPTS = "target_id string, checked_at timestamp, url_tried string, outcome string, note string"
SITEMAP_STATE = "org_id string, origin string, fingerprint string"
