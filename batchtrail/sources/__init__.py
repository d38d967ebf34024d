"""Sources and sinks: schemas, scans, fixture views, stage catalogue, export writers."""
