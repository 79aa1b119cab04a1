"""Sources and sinks: file trees, version control, syntax trees, snapshots."""
