"""Mail files to message rows."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MESSAGE = "path string, subject string, sender string, sender_name string, `to` array<string>, cc array<string>, date string, message_id string, in_reply_to string, refs array<string>, body string, attachments array<string>"


def parsed(raw: bytes) -> dict:
    """A message's headers and its text; an HTML body counts without its tags."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    people = lambda key: [(n, a) for n, a in email.utils.getaddresses([str(x) for x in m.get_all(key, [])]) if a]
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = re.sub("<[^>]*>", "", text)
    try:
        date = m["date"].datetime.isoformat() if m["date"] else None
    except (AttributeError, TypeError, ValueError):
        date = None
    ids = re.findall(r"<([^>]+)>", str(m.get("references", "")))
    sender = (people("from") or [("", "")])[0]
    return {"subject": str(m.get("subject", "")), "sender": sender[1], "sender_name": sender[0] or None, "to": [a for _, a in people("to")], "cc": [a for _, a in people("cc")], "date": date, "message_id": str(m.get("message-id", "")).strip("<> "), "in_reply_to": str(m["in-reply-to"]).strip("<> ") if m["in-reply-to"] else None, "refs": ids, "body": text, "attachments": [f"{a.get_filename()} ({a.get_content_type()})" for a in m.iter_attachments() if a.get_filename()]}


def messages(files: DataFrame) -> DataFrame:
    """MESSAGE rows of files (path, content as bytes); a mailbox file holds one after each "From " line."""
    names = [x.split()[0].strip("`") for x in MESSAGE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                raw = bytes(raw or b"")
                parts = re.split(rb"(?m)^From [^\n]*\n", raw)[1:] if raw.startswith(b"From ") else [raw]
                rows += [{"path": path} | parsed(x) for x in parts if x.strip()]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select("path", "content").mapInPandas(run, MESSAGE)
