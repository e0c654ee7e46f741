"""Tables, message logs and writers."""
