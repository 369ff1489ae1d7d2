"""Lead quality, scoring and evidence jobs for CRM data, written for Spark."""
