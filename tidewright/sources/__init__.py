"""Sources and sinks: commit log, journals, OTLP, generators."""
