"""Write-once sinks: files, folders and packages that appear whole or not at all, and workbooks."""
