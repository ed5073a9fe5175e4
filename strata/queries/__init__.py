"""Query registrations, grouped like the operator inventory (dependency order: marts register the
mart CTEs the later modules reuse)."""

from . import conformed, marts, reports, scalars, relational, quality, upserts, io, history  # noqa: F401
