"""Jobs that keep the tables small: retention, and one file per finished day."""
from __future__ import annotations

from ..schemas import KEYS
from ..settings import Settings
from ..sources.tables import TableStore
from .delivery import AlertDelivery
from .rollup import merge_parts


def retain(store: TableStore, as_of: str, settings: Settings = Settings(), delivery: AlertDelivery | None = None) -> dict[str, list[str]]:
    """Prune every table by its number of days; gives the dates that changed.

    Of the alert queue only sent and discarded rows go, so it needs the delivery job's log.
    """
    changed = {}
    for name, days in settings.retention_days.items():
        if name != "alert_outbox":
            changed[name] = store.prune(name, as_of, days)
        elif delivery is not None:
            changed[name] = delivery.retain(as_of, days)
    return changed


def compact(store: TableStore, name: str, before: str) -> list[str]:
    """Rewrite the days before a date, each as one batch, with the parts of a minute merged.

    Only days whose batches are over may be compacted: a batch that runs again would write
    its folder anew. Late rows of a compacted day make further batches, for the next time.
    """
    merge = merge_parts if name == "energy_readings_1min" else None
    assert merge or name in KEYS, name
    return store.rewrite(name, before, merge)
