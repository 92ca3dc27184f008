"""Reading and writing: activity files, text lists, stores, predictions, reports, models."""
