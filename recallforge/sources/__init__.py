"""Sources and sinks: binary containers, JSON lines and text, cards, file trees, exports, object stores."""
