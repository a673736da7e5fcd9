"""Tables, imports, generators and sinks."""
