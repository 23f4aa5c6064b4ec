"""Sources (the sharded session table, its export from the test tables) and
the partitioned prediction sink."""

from .sessions import SessionStore, read_sessions  # noqa: F401
