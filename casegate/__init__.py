"""casegate: integrity-checked intake, rule-based placement and reconciliation
of legacy case records, written as PySpark DataFrame jobs."""
