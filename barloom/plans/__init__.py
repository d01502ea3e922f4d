"""Block layout of long series, staging, and the multi-step pipelines."""
