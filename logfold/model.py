"""Schemas, statuses and errors that the log, the tables and the sources share."""

from __future__ import annotations

FRAME_SCHEMA = "frame_no long, pg_no long, n_truncate long, salt1 long, salt2 long, ck1 long, ck2 long, data binary"
PAGE_SCHEMA = "pg_no long, data binary"
LOG_SCHEMA = "idx long, term long, type int, data binary, extensions binary, appended_at long"
ENTRY_SCHEMA = "id string, n_truncate long, pages array<struct<pg_no: bigint, data: binary>>"
STATUSES = ("OK", "STALE_BASE", "CATCHING_UP", "BUSY", "NOT_LEADER", "INVALID", "AMBIGUOUS")


class CommitError(Exception):
    """A commit that did not take effect, or may have. safe_to_retry: it certainly did not, and may later."""

    status = "AMBIGUOUS"
    code = "IOERR_WRITE"
    safe_to_retry = False


class StaleBaseError(CommitError):
    """The table moved on since the base version was read."""

    status, code, safe_to_retry = "STALE_BASE", "BUSY", True


class LeaseBusyError(CommitError):
    """Another writer holds the write lease."""

    status, code, safe_to_retry = "BUSY", "BUSY", True


class InvalidChangeError(CommitError):
    """A change set of the wrong shape: certainly not applied, and it never will be."""

    status = "INVALID"


class ConstraintError(InvalidChangeError):
    """A row that breaks NOT NULL, UNIQUE, the primary key or a guard."""


class FatalCommitError(CommitError):
    """A commit whose publication could not be told to have happened."""


class NotFoundError(KeyError):
    """A log index, key or version that is not there."""

    def __str__(self) -> str:
        return "not found"
