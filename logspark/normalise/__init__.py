"""Raw records in many wire formats to typed log and web-event rows."""
