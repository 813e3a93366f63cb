"""Messages about runs: events of a run to callables, web hooks or mail, by what a contract asks for.

Sending is driver work and never fails a run: what went wrong is returned.
"""

from __future__ import annotations

import json
import smtplib
import string
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from email.message import EmailMessage
from typing import Any

#: what a run can tell of
EVENTS = ("quarantine", "failure", "schema_drift", "dataset_rule_failed", "service_level_broken", "success")


@dataclass(frozen=True)
class Target:
    """Where messages go and which: ``kind`` is call, webhook or mail."""

    kind: str
    to: Any
    events: tuple[str, ...] = EVENTS
    subject: str = "$contract: $event"
    text: str = "$message"
    options: dict[str, Any] = field(default_factory=dict)


def targets_of(config: list[dict[str, Any]] | None) -> list[Target]:
    """A contract's ``notifications``."""
    out = []
    for c in config or []:
        events = c.get("on_events") or c.get("events") or EVENTS
        unknown = set(events) - set(EVENTS)
        if unknown:
            raise ValueError(f"unknown events: {', '.join(sorted(unknown))}")
        known = {"type", "target", "on_events", "events", "subject_template", "message_template"}
        out.append(Target(c.get("type", "webhook"), c["target"], tuple(events), c.get("subject_template", Target.subject), c.get("message_template", Target.text), {k: v for k, v in c.items() if k not in known}))
    return out


def _send(target: Target, subject: str, text: str, post: Callable[[str, bytes], Any] | None) -> None:
    if target.kind == "call":
        target.to(subject, text)
    elif target.kind == "webhook":
        body = json.dumps({"subject": subject, "text": text}).encode()
        if post is not None:
            post(target.to, body)
            return
        request = urllib.request.Request(target.to, body, {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=10).close()  # noqa: S310 - the address is the contract's
    elif target.kind == "mail":
        mail = EmailMessage()
        mail["Subject"], mail["From"], mail["To"] = subject, target.options.get("sender", "millrace@localhost"), target.to
        mail.set_content(text)
        with smtplib.SMTP(target.options.get("host", "localhost"), int(target.options.get("port", 25)), timeout=10) as server:
            server.send_message(mail)
    else:
        raise ValueError(f"unknown kind of target: {target.kind}")


def notify(targets: list[Target], event: str, contract: str, message: str, post: Callable[[str, bytes], Any] | None = None, **values: Any) -> list[str]:
    """Send an event to all targets that want it; faults, if any."""
    faults = []
    for t in targets:
        if event not in t.events:
            continue
        known = {"event": event, "contract": contract, "message": message, **values}
        try:
            _send(t, string.Template(t.subject).safe_substitute(known), string.Template(t.text).safe_substitute(known), post)
        except Exception as e:  # noqa: BLE001 - a message is no reason for a run to fail
            faults.append(f"{t.kind}: {e}")
    return faults


def events_of(counts: dict[str, int], results: list[Any], broken: list[str]) -> list[tuple[str, str]]:
    """(event, message) of a finished run."""
    out = []
    if counts["quarantined"]:
        out.append(("quarantine", f"{counts['quarantined']} of {counts['total']} rows were rejected"))
    out += [("dataset_rule_failed", f"{r.name}: {r.value}") for r in results if r.passed is False]
    out += [("service_level_broken", name) for name in broken]
    return out or [("success", f"{counts['good']} rows")]
