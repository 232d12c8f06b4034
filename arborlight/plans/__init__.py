"""Plan building blocks: sessions, durable intermediates, connected components."""
