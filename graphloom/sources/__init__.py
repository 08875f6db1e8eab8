"""Sources and sinks: node feeds, CSV, exports, blobs, dumps."""
