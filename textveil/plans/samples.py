"""One text for each rule that it hits, in catalogue order: made up, with no real person or key."""

HEX40 = "0123456789abcdef0123456789abcdef01234567"

SAMPLES = [
    "write to John.Doe+x@Mail.example.org now",
    "call 9876543210 today",
    "call 415-555-2671 today",
    "call 416.555.2671 today",
    "ring 07123 456789 ok",
    "ring 13812345678 ok",
    "ring 0412 345 678 ok",
    "ring 0301234567 ok",
    "dial x+33 142685300 ok",
    "ssn 123-45-6789 end",
    "id 2345 6789 0123 end",
    "pan ABCDE1234F end",
    "nino ab 12 34 56 c end",
    "sin 123-456-789 end",
    "tfn 123 456 789 end",
    "cn 11010519491231002X end",
    "pass A12 34567 end",
    "pass 912345678 end",
    "pass 012345678 end",
    "pass AB12CD34 end",
    "dl MH-12-20110012345 end",
    "dl A1234567 end",
    "dl A1234-56789-01234 end",
    "dl B12345678901 end",
    "dl MORGA657054SMAB end",
    "visa 4111111111111111 end",
    "mc 5500005555555559 end",
    "amex 340000000000009 end",
    "disc 6011000990139424 end",
    "card 1234 5678 9012 3456 end",
    "aba 021000021 end",
    "iban DE89370400440532013000 end",
    "ifsc HDFC0123456 end",
    "micr 560229003 end",
    "bic DEUTDEFF500 end",
    "btc 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2 end",
    "eth 0x52908400098527886E0F7030069857D2E4169EE7 end",
    "tok tok_" + "a1" * 12 + " end",
    "ip 192.168.10.254 end",
    "ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 end",
    "mac aa:bb:cc:dd:ee:ff end",
    "imei 490154203237518 end",
    "uuid 123e4567-e89b-12d3-a456-426614174000 end",
    "icd J45.901 end",
    "nhs 943 476 5919 end",
    "mbi 1EG4-TE5-M73 end",
    "policy POL-12345-X end",
    "voter ABC1234567 end",
    "vin 1HGCM82633A004352 end",
    "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<<<",
    "the Date of Birth: 01/02/1990 end",
    "key " + "abcd1234" * 4 + " end",
    "key AIza" + "B" * 35 + " end",
    "key AKIA" + "Z" * 16 + " end",
    "key " + "a/B3" * 10 + " end",
    "key xox" + "b-123456789012-123456789012-123456789012-" + "a" * 32 + " end",
    "key sk_" + "live_" + "4" * 24 + " end",
    "key pk_" + "test_" + "4" * 24 + " end",
    "key eyJhbGciOi.eyJzdWIi.sig-_ end",
    "key " + "x~y." * 12 + "z end",
    "uri mongodb+srv://user:pw@host.example/db end",
    "uri redis://:pw@cache.example:6379 end",
    "ssh-rsa AAAAB3NzaC1yc2E= me",
    "-----BEGIN PRIVATE" + " KEY-----",
    "-----BEGIN EC PRIVATE" + " KEY-----",
    "arn:aws:secretsmanager:us-east-1:123456789012:secret:prod/db-Ab12",
    f"key {HEX40} end",
    "mail my-service@my-project.iam.gserviceaccount.com end",
    "key " + "Ab3~" * 9 + " end",
    "key " + "Ab3/" * 21 + "xy== end",
    "key ghp_" + "a" * 36 + " end",
    "key glpat-" + "a" * 20 + " end",
    "key npm_" + "a" * 36 + " end",
    "key abc.atlasv1." + "a" * 60 + " end",
    "key 12345678-1234-8234-1234-123456789abc end",
    "https://hooks.slack.com/services/T12345678/B12345678/" + "a" * 24,
    "my password = 'hunter22hunter' ok",
]
