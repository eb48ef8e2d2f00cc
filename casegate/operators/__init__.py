"""DataFrame-to-DataFrame operators of the intake, placement and reconciliation."""
