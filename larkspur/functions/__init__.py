"""Column expressions: from columns to a column, no DataFrame involved."""
