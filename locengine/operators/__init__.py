"""DataFrame operators: extraction, memory, batches, quality, review, rebuild, jobs."""
