"""Time-card and payroll audits as Spark DataFrame plans."""
