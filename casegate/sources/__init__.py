"""Readers and writers: text exports, manifests, expectations, rule tables,
ledger events, instance snapshots and reports."""
