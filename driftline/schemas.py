"""Schemas of the engine's tables, as DDL: importing needs no session."""

from __future__ import annotations

from enum import Enum


class SyncMode(Enum):
    FULL_REPLACE = "full_replace"
    INCREMENTAL_UPDATE = "incremental_update"


EVENT = (
    "title string not null, start_date date not null, end_date date not null, description string, location string, "
    "attendees array<string>, start_time string, end_time string, sheet_name string, row_no bigint, ordinal struct<book:string,sheet:int,row:bigint>"
)
_MOMENT = "struct<dateTime:string,date:string,timeZone:string>"
REMOTE_EVENT = (
    f"id string not null, summary string, description string, location string, start {_MOMENT}, end {_MOMENT}, attendees array<struct<email:string>>"
)
REJECT = "sheet_name string, row_no bigint, reason string"
WARNING = "sheet_name string, warning string"
USER_TOKENS = (
    "user_id string not null, email string not null, access_token string not null, refresh_token string, token_expiry timestamp not null, "
    "scopes array<string> not null, created_at timestamp not null, updated_at timestamp not null"
)
WEB_SESSIONS = (
    "session_id string not null, user_id string, email string, name string, oauth_state string, sheets_mode boolean, created_at timestamp, expires_at timestamp"
)
REQUIRED = ("title", "start_date", "end_date")
LINEAGE = ("sheet_name", "row_no", "ordinal")
FIELDS = ("title", "start_date", "end_date", "description", "location", "attendees", "start_time", "end_time")
