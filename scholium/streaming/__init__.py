"""Live versions of the daily totals, sessions, milestones and logs."""
