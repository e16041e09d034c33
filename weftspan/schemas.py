"""Record shapes shared by the pipeline, and constants with fixed meanings."""

from __future__ import annotations

SPAN = "job_name string, job_id string, event_type string, event_id string, start_timestamp bigint, end_timestamp bigint, application_name string, parent_event_id string, child_event_ids array<string>"
PV = "jobId string, eventId string, eventType string, timestamp string, applicationName string, jobName string, previousEventIds array<string>"
EVENT_SET = "array<struct<eventType:string,count:int>>"
MODEL_ROWS = f"job_name string, event_type string, direction string, event_set {EVENT_SET}"
MODEL = f"job_name string, events array<struct<eventType:string,outgoingEventSets:array<{EVENT_SET}>,incomingEventSets:array<{EVENT_SET}>>>"

#: Fields a span must have; a record without one is rejected.
MANDATORY = ("job_name", "job_id", "event_type", "event_id", "start_timestamp", "end_timestamp", "application_name")

# Names of the artificial events.
START_EVENT = "|||START|||"
END_EVENT = "|||END|||"
DUMMY_EVENT = "|||DUMMY|||"
LOOP_EVENT = "LOOP"
DUMMY_BREAK_EVENT = "DUMMY_BREAK"
# Bounds of an empty time range.
MIN_TIMESTAMP = 0
MAX_TIMESTAMP = 2**63 - 1
